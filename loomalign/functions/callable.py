"""Alignment as functions that SQL can call: a vectorised scalar function and a table function."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf, udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from loomalign.functions.scoring import algorithm_name, encode
from loomalign.operators import kernels

#: From so many residues on a target is scored by itself.
THRESHOLD = 4096


#: Types as objects: text would need a session when this is imported.
_PATH = StructType([StructField(n, StringType() if n == "cigar" else IntegerType()) for n in ("q_begin", "q_end", "t_begin", "t_end", "identities", "gaps", "cigar", "path_score")])


@arrow_udf(IntegerType())
def align_score(query: pa.Array, seq: pa.Array, algorithm: pa.Array) -> pa.Array:
    """The score of each pair; null where any argument is.  Rows of one query and algorithm are scored together."""
    out: list = [None] * len(seq)
    by: dict[tuple, list[int]] = {}
    seqs = seq.to_pylist()
    for i, key in enumerate(zip(query.to_pylist(), algorithm.to_pylist(), strict=True)):
        if None not in key and seqs[i] is not None:
            by.setdefault(key, []).append(i)
    for (q, name), at in by.items():
        for i, v in zip(at, np.asarray(kernels.scores(algorithm_name(name), encode(q), [encode(seqs[i]) for i in at], THRESHOLD)).tolist(), strict=True):
            out[i] = v
    return pa.array(out, pa.int32())


def _aligned(algorithm: str, query: str, seq: str) -> tuple:
    from loomalign.operators.traceback import aligned

    return tuple(aligned(algorithm, encode(query), encode(seq)).values())


#: Characters of a pair up to which a worker remembers its path.
SHORT = 512


@lru_cache(1 << 13)
def _recent(algorithm: str, query: str, seq: str) -> tuple:
    """The last paths that a worker found, some 10 MB of them: short sequences repeat."""
    return _aligned(algorithm, query, seq)


@udtf(returnType=_PATH)
class align_path:
    """One row with the alignment of a pair; none where an argument is null."""

    def eval(self, query: str, seq: str, algorithm: str):
        if query is not None and seq is not None and algorithm is not None:
            yield (_recent if len(query) + len(seq) <= SHORT else _aligned)(algorithm, query, seq)


def register(spark: SparkSession) -> None:
    """``align_score(query, seq, algorithm)`` and ``align_path(query, seq, algorithm)`` for SQL of this session."""
    spark.udf.register("align_score", align_score)
    spark.udtf.register("align_path", align_path)
