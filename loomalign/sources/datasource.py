"""``spark.read.format("fasta")``: FASTA files by a Python data source, for one path of files that Python can open.

``fasta.read_fasta`` is the way to read at scale: it splits files and reads any
store that Spark reads.  This format serves where a plain reader is wanted.
"""

from __future__ import annotations

import glob
import os

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class FastaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "target_id long, header string, seq string, len int"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        path = path.removeprefix("file://")
        self.files = sorted(glob.glob(os.path.join(path, "*")) if os.path.isdir(path) else glob.glob(path))
        if not self.files:
            raise FileNotFoundError(path)

    def partitions(self):
        return [InputPartition((i, f)) for i, f in enumerate(self.files)]

    def read(self, partition):
        number, file = partition.value
        header, lines, k = None, [], 0
        with open(file, encoding="utf-8", newline="\n") as f:
            for raw in f:
                line = raw.rstrip("\n")
                if line.startswith(">"):
                    if header is not None:
                        if not lines:
                            raise ValueError(f"{file}: a header is followed by another header")
                        yield self._row(number, k, header, lines)
                        k += 1
                    header, lines = line[1:].removesuffix("\r"), []
                elif header is None:
                    raise ValueError(f"{file}: a FASTA file begins with '>'")
                elif line:
                    lines.append(line.removesuffix("\r"))
        if header is None:
            raise ValueError(f"{file}: no sequence")
        if lines:
            yield self._row(number, k, header, lines)

    @staticmethod
    def _row(number, k, header, lines):
        seq = "".join(lines)
        return ((number << 33) + k, header, seq, len(seq.encode()))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastaSource)
