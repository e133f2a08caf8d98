"""FASTA files read once: records as Parquet, an index of where they lie, and ranges of records that read no more than they need.

``build`` makes one pass over the files, whatever their number and size: Spark
splits them, and a task tells from the reader's own metadata in which file and at
which offset the split began that a record came from, so it counts records within
the split as they come by, and nothing is sorted, shuffled or joined.  What is
known of each split (records, residues) is one index row; files by name and splits
by offset give every split the number of its first record.  The same rows tell
whether the files are valid: they begin with '>', and only a file's last record
may be without sequence lines.

``read_range`` gives records by number, in the order of file names and places in
them.  It takes the splits that overlap the range from the index, and their files
and offsets go to the Parquet scan as filters, so the first 25 records of any
database cost one split's row groups.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORDS = "file string, block long, at long, header string, seq string, len int, bare boolean"
#: Splits up to which a range's own are named one by one in the scan's filter.
_NAMED = 64


def parsed(batches):
    """Records of each split with their number in it; those without sequence lines are counted but have none."""
    current, kept = None, 0
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("file", "block", "at", "header", "seq", "len", "bare")}
        for value, file, block in zip(batch.column("value").to_pylist(), batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True):
            first = (file, block) != current
            if first:
                current, kept = (file, block), 0
                # Only a file's first record keeps its own '>'.
                if block == 0 and not value.startswith(">"):
                    raise ValueError(f"{file}: a FASTA file begins with '>'")
            if block == 0 and first:
                value = value[1:]
            lines = value.split("\n")
            body = [x for x in lines[1:] if x != ""]
            seq = "".join(x.removesuffix("\r") for x in body)
            out["file"].append(file)
            out["block"].append(block)
            out["at"].append(kept)
            out["header"].append(lines[0].removesuffix("\r"))
            out["seq"].append(seq if body else None)
            out["len"].append(len(seq.encode()) if body else None)
            out["bare"].append(not body)
            kept += bool(body)
        yield pa.RecordBatch.from_arrays([pa.array(out["file"]), pa.array(out["block"], pa.int64()), pa.array(out["at"], pa.int64()), pa.array(out["header"], pa.string()), pa.array(out["seq"], pa.string()), pa.array(out["len"], pa.int32()), pa.array(out["bare"], pa.bool_())], list(out))


def build(spark: SparkSession, path: str, store: str, strict: bool = True) -> None:
    """Records and index of a FASTA file or folder, written below ``store``.

    With ``strict``, a header that another follows directly is an error (of the
    build, which then leaves no index); otherwise such records are left out.  A
    header without sequence lines at the end of a file is left out.  Blank lines
    are ignored, a line with only a carriage return is an empty sequence line,
    '>' inside a line is data.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    raw.mapInArrow(parsed, RECORDS).write.mode("overwrite").parquet(f"{store}/records")
    rows = spark.read.schema(RECORDS.replace("", "")).parquet(f"{store}/records")
    # Of the bare records only the last of its split, behind all others, can end a file.
    kept = F.count_if(~F.col("bare"))
    splits = rows.groupBy("file", "block").agg(kept.alias("n"), F.sum("len").alias("residues"), F.count_if("bare").alias("bare"), F.max(F.when(F.col("bare"), F.col("at"))).alias("bare_at"))
    later = Window.partitionBy("file").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("behind", F.coalesce(F.count("*").over(later), F.lit(0)))
    wrong = (F.col("bare") > 1) | ((F.col("bare") == 1) & ((F.col("bare_at") < F.col("n")) | (F.col("behind") > 0)))
    order = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each split of some 128 MB: the only thing that passes through one task.
    index = splits.withColumn("wrong", wrong).withColumn("first", F.coalesce(F.sum("n").over(order), F.lit(0)).cast("long"))
    index = index.select("file", "block", "first", "n", F.coalesce("residues", F.lit(0)).cast("long").alias("residues"), "wrong")
    if strict and (bad := index.where("wrong").orderBy("file", "block").first()) is not None:
        raise ValueError(f"{bad.file}: a header is followed by another header")
    index.drop("wrong").write.mode("overwrite").parquet(f"{store}/index")


def index_of(spark: SparkSession, store: str) -> DataFrame:
    """(file, block, first, n, residues): a row for each split that was read."""
    return spark.read.schema("file string, block long, first long, n long, residues long").parquet(f"{store}/index")


def read_range(spark: SparkSession, store: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """(target_id, header, seq, len) of the records with numbers from ``start`` up to ``stop`` (not included; all by default)."""
    if start < 0 or (stop is not None and stop < start):
        raise ValueError("a range of records begins at 0 or later and does not end before it begins")
    splits = index_of(spark, store).where(F.col("n") > 0)
    rows = spark.read.schema(RECORDS.replace("", "")).parquet(f"{store}/records").where(~F.col("bare"))
    if start or stop is not None:
        splits = splits.where(F.col("first") + F.col("n") > start)
        if stop is not None:
            splits = splits.where(F.col("first") < stop)
        few = splits.select("file", "block").limit(_NAMED + 1).collect()
        if not few:
            rows = rows.where(F.lit(False))
        elif len(few) <= _NAMED:
            rows = rows.where(F.col("file").isin(sorted({r.file for r in few})) & F.col("block").between(min(r.block for r in few), max(r.block for r in few)))
    rows = rows.join(F.broadcast(splits.select("file", "block", "first")), ["file", "block"]).withColumn("target_id", F.col("first") + F.col("at"))
    if start:
        rows = rows.where(F.col("target_id") >= start)
    if stop is not None:
        rows = rows.where(F.col("target_id") < stop)
    return rows.select("target_id", "header", "seq", "len")
