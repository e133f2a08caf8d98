"""Tables between the rounds of one job, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from loomalign.sources.fasta import shared_dir

_KEPT: dict[str, SparkSession] = {}


def staged(df: DataFrame, name: str = "round") -> DataFrame:
    """The rows written and read again: what follows needs nothing that came before, whatever executors are lost.

    The table is deleted by ``drop``, at the latest when the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid4().hex}"
    if not _KEPT:
        atexit.register(_drop_all)
    _KEPT[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop(df: DataFrame) -> None:
    """Delete a staged table that nothing will read any more."""
    path = df._staged
    delete(_KEPT.pop(path), path)


def at_exit(spark: SparkSession, path: str) -> str:
    """Have a path of one's own in the shared folder deleted when the process ends."""
    if not _KEPT:
        atexit.register(_drop_all)
    _KEPT[path] = spark
    return path


def _drop_all() -> None:
    for path, spark in list(_KEPT.items()):
        if spark.sparkContext._jsc is not None:  # a stopped context has none
            delete(spark, path)
        _KEPT.pop(path)
