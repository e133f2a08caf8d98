"""Comparison of score sets, and the metrics of a run."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRICS = "algorithm string, query_len int, impl string, latency_ms double, cells long, gcups double"


def mismatches(gold: DataFrame, test: DataFrame, keys: tuple[str, ...] = ("query_id", "target_id")) -> DataFrame:
    """(keys, gold, test) of all pairs whose scores differ or that one side lacks."""
    a = gold.select(*keys, F.col("score").alias("gold"))
    b = test.select(*keys, F.col("score").alias("test"))
    return a.join(b, list(keys), "full_outer").where(~F.col("gold").eqNullSafe(F.col("test")))


def mismatch_summary(gold: DataFrame, test: DataFrame, keys: tuple[str, ...] = ("query_id", "target_id")) -> DataFrame:
    """(pairs, different): one row."""
    a = gold.select(*keys, F.col("score").alias("gold"))
    b = test.select(*keys, F.col("score").alias("test"))
    return a.join(b, list(keys), "full_outer").agg(F.count("*").alias("pairs"), F.count_if(~F.col("gold").eqNullSafe(F.col("test"))).alias("different"))


def check(gold: DataFrame, test: DataFrame, name: str, keys: tuple[str, ...] = ("query_id", "target_id")) -> None:
    """Raises with the first three mismatches, if there are any."""
    bad = mismatches(gold, test, keys).orderBy(*keys).limit(3).collect()
    if bad:
        raise AssertionError(f"{name}: scores differ: " + "; ".join(f"{[r[k] for k in keys]} {r.gold} {r.test}" for r in bad))


def cells(targets: DataFrame, query_len: int) -> DataFrame:
    """(sequences, longest, residues, cells) of a search: one row."""
    total = F.sum(F.col("len").cast("long"))
    return targets.agg(F.count("*").alias("sequences"), F.max("len").alias("longest"), total.alias("residues"), (total * query_len).alias("cells"))


def gcups(cells, ms):
    """Billions of cell updates a second, from cells and milliseconds."""
    return cells / (ms * 1e6)


def timed(make, repeats: int = 3, warm_up: int = 1) -> float:
    """Mean milliseconds of running make() to its end (rows are made and dropped), after a warm-up."""
    for _ in range(warm_up):
        make().write.format("noop").mode("overwrite").save()
    total = 0.0
    for _ in range(repeats):
        began = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        total += time.perf_counter() - began
    return total / repeats * 1000


def measured(targets: DataFrame, query: str, algorithm: str, impl: str, make, repeats: int = 3) -> tuple:
    """A row of METRICS."""
    n = cells(targets, len(query)).first().cells or 0
    ms = timed(make, repeats)
    return (algorithm, len(query), impl, ms, n, gcups(n, ms))


def sweep(run, **parameters: list):
    """run(**choice) for every combination of the parameters, as rows of dicts."""
    import itertools

    names = list(parameters)
    return [dict(zip(names, choice, strict=True)) | run(**dict(zip(names, choice, strict=True))) for choice in itertools.product(*parameters.values())]


def speedup(metrics: DataFrame, base: str) -> DataFrame:
    """Adds speedup: latency of implementation ``base`` over the row's own, by algorithm and query length."""
    of = Window.partitionBy("algorithm", "query_len")
    return metrics.withColumn("speedup", F.max(F.when(F.col("impl") == base, F.col("latency_ms"))).over(of) / F.col("latency_ms"))


def best_threshold(metrics: DataFrame) -> DataFrame:
    """(algorithm, query_len, threshold): the threshold of least latency; rows without one (pure runs) don't count."""
    return metrics.where("threshold is not null").groupBy("algorithm", "query_len").agg(F.min_by("threshold", F.struct("latency_ms", "threshold")).alias("threshold"))


def peak(metrics: DataFrame) -> DataFrame:
    """(algorithm, impl, query_len): where throughput is highest, the shortest query of equal ones."""
    return metrics.groupBy("algorithm", "impl").agg(F.min_by("query_len", F.struct(-F.col("gcups"), "query_len")).alias("query_len"))


def crossover(metrics: DataFrame, impl: str, base: str) -> DataFrame:
    """(algorithm, query_len): the shortest query for which ``impl`` beats ``base``; null if none."""
    both = metrics.groupBy("algorithm", "query_len").agg(F.max(F.when(F.col("impl") == impl, F.col("gcups"))).alias("a"), F.max(F.when(F.col("impl") == base, F.col("gcups"))).alias("b"))
    return both.groupBy("algorithm").agg(F.min(F.when(F.col("a") > F.col("b"), F.col("query_len"))).alias("query_len"))
