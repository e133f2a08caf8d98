"""Order, limits, samples, routes and batch layout of sequence databases, as DataFrame operations."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANES = 32
#: Rows that a top-n may bring together in one task.
GATHER = 10_000


def by_length(df: DataFrame, key: str = "target_id") -> DataFrame:
    """Shortest first; equal lengths by id."""
    return df.orderBy("len", key)


def n_shortest(df: DataFrame, n: int, key: str = "target_id", gather: int = GATHER) -> DataFrame:
    """The n shortest; equal lengths by id.

    Up to ``gather`` rows are a distributed top-n, in order.  More never meet in
    one task: a histogram of lengths gives the length at which the n-th lies,
    shorter rows stay as they are read, and of that length alone places decide.
    """
    if n <= gather:
        return df.orderBy("len", key).limit(n)
    upto = Window.orderBy(F.asc_nulls_first("len")).rowsBetween(Window.unboundedPreceding, 0)
    counts = df.groupBy("len").agg(F.count("*").alias("n")).withColumn("all", F.sum("n").over(upto))
    cut = counts.where(F.col("all") >= n).orderBy("all").limit(1).collect()
    if not cut:
        return df
    at = F.col("len").eqNullSafe(F.lit(cut[0].len))
    ties = positioned(df.where(at).select(key, "len"), key).where(F.col("ord") < n - (cut[0]["all"] - cut[0].n)).select(F.col(key).alias("_key")).distinct()
    below = F.lit(False) if cut[0].len is None else F.col("len").isNull() | (F.col("len") < cut[0].len)
    return df.where(below).unionByName(df.where(at).join(ties, F.col(key).eqNullSafe(F.col("_key")), "left_semi"))


def hash_sample(df: DataFrame, n: int, seed: int = 0, key: str = "target_id", gather: int = GATHER) -> DataFrame:
    """Exactly n rows (all if fewer), without replacement, the same for the same seed."""
    return _least(df, n, F.lpad(F.hex(F.xxhash64(F.col(key), F.lit(seed))), 16, "0"), key, gather)


def md5_sample(df: DataFrame, n: int, seed: int = 0, key: str = "target_id", gather: int = GATHER) -> DataFrame:
    """The same by a hash that other engines have too."""
    return _least(df, n, F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key, gather)


def _least(df: DataFrame, n: int, digest: Column, key: str, gather: int, step: int = 4) -> DataFrame:
    """The n rows of the least digests (hexadecimal digits of one length), then keys.

    Up to ``gather`` rows are a distributed top-n.  More never meet in one task: counts by
    leading digits tell in which cell the n-th row lies; what is in cells before
    it stays where it is read, and within the cell further digits decide, until
    at most ``gather`` of its rows are wanted, or all of a cell's rows have one digest.
    """
    if n <= gather:
        return df.orderBy(digest, key).limit(n)
    rows = df.withColumn("_digest", digest)
    prefix, taken = "", None
    while True:
        cell = rows.where(F.col("_digest").startswith(prefix)) if prefix else rows
        size = len(prefix) + step
        counts = sorted((r.cell, r.n) for r in cell.groupBy(F.substring("_digest", 1, size).alias("cell")).agg(F.count("*").alias("n")).collect())
        before, edge = 0, None
        for name, count in counts:
            if before + count > n:
                edge = name
                break
            before += count
        whole = cell if edge is None else cell.where(F.substring("_digest", 1, size) < edge)
        taken = whole if taken is None else taken.unionByName(whole)
        n -= before
        if edge is None or n <= 0:
            return taken.drop("_digest")
        rest = rows.where(F.col("_digest").startswith(edge))
        if n <= gather or len(edge) < size:  # digits that are used up: rows of one digest, as good as each other
            return taken.unionByName(rest.orderBy("_digest", key).limit(n)).drop("_digest")
        prefix = edge


def routed(df: DataFrame, threshold: int) -> DataFrame:
    """Adds route: large from ``threshold`` residues on, small below."""
    if threshold <= 0:
        raise ValueError("the threshold is a positive number")
    return df.withColumn("route", F.when(F.col("len") >= threshold, "large").otherwise("small"))


def _ranged(df: DataFrame, key: str, parts: int) -> DataFrame:
    """Adds _part: which of up to ``parts`` ranges of about as many rows a (numeric) id lies in, in rising order; null for none."""
    from pyspark.ml.feature import Bucketizer  # here, so that tasks that import this module do not load it

    rows = df.withColumn("_value", F.col(key).cast("double"))
    found = rows.agg(F.percentile_approx("_value", [i / parts for i in range(1, parts)], 10_000).alias("q")).first().q or []
    bounds = sorted({*found, float("-inf"), float("inf")})
    if len(bounds) < 3:  # too few values for more than one range
        return rows.withColumn("_part", F.when(F.col("_value").isNotNull(), F.lit(0.0))).drop("_value")
    ranges = Bucketizer(splits=bounds, inputCol="_value", outputCol="_part", handleInvalid="keep")
    return ranges.transform(rows).withColumn("_part", F.when(F.col("_value").isNotNull(), F.col("_part"))).drop("_value")


def positioned(df: DataFrame, key: str = "target_id", parts: int = 1024) -> DataFrame:
    """Adds ord (place in length order, from 0) and start (residues before it), by length and then (numeric) id.

    A global running sum without one task for all rows: ids fall in ``parts``
    ranges that hold about as many rows each, however ids are spread (their
    quantiles are looked up first); sums by length, then by range within a
    length, then places within each range are added up.  Only the sums by length, a row for
    each different length, pass through one task, so a length that all rows
    have is still many tasks.  Null lengths come last and have no residues; null
    ids come last of their length.
    """
    rows = _ranged(df, key, parts)
    sums = rows.groupBy(F.col("len").alias("_len"), F.col("_part").alias("_of")).agg(F.count("*").alias("_n"))
    by_length = Window.orderBy(F.asc_nulls_last("_in")).rowsBetween(Window.unboundedPreceding, -1)
    lengths = sums.groupBy(F.col("_len").alias("_in")).agg(F.sum("_n").alias("_all"))
    run = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    residues = F.col("_all") * F.coalesce(F.col("_in").cast("long"), F.lit(0))
    lengths = lengths.select("_in", run("_all", by_length).alias("_base"), run(residues, by_length).alias("_base_r"))
    by_range = Window.partitionBy("_len").orderBy(F.asc_nulls_last("_of")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", run("_n", by_range)).join(lengths, F.col("_len").eqNullSafe(F.col("_in")))
    sums = sums.select("_len", "_of", (F.col("_base") + F.col("_before")).alias("_first"), (F.col("_base_r") + F.col("_before") * F.coalesce(F.col("_len").cast("long"), F.lit(0))).alias("_first_r"))
    within = Window.partitionBy("len", "_part").orderBy(F.asc_nulls_last(key))
    return (
        rows.withColumn("_rank", F.row_number().over(within) - 1)
        .join(sums, F.col("len").eqNullSafe(F.col("_len")) & F.col("_part").eqNullSafe(F.col("_of")))
        .select(*df.columns, (F.col("_first") + F.col("_rank")).alias("ord"), (F.col("_first_r") + F.col("_rank") * F.coalesce("len", F.lit(0))).cast("long").alias("start"))
    )


def batch_of(df: DataFrame, lanes: int = LANES) -> DataFrame:
    """Adds batch (of ``lanes`` sequences in length order) and lane to positioned rows."""
    return df.withColumn("batch", F.floor(F.col("ord") / lanes)).withColumn("lane", F.col("ord") % lanes)


def batch_layout(df: DataFrame, lanes: int = LANES) -> DataFrame:
    """(batch, n, width, cells, padding): sequences of each batch, its longest, cells with padding and the padding."""
    cells = F.col("width") * lanes
    out = batch_of(df, lanes).groupBy("batch").agg(F.count("*").alias("n"), F.max("len").alias("width"), F.sum(F.col("len").cast("long")).alias("residues"))
    return out.select("batch", "n", "width", cells.cast("long").alias("cells"), (cells - F.col("residues")).cast("long").alias("padding"))


def batch_offsets(layout: DataFrame, lanes: int = LANES, block: int = 4096) -> DataFrame:
    """Adds the running starts of each batch's residues and of its two rows of cells.

    In two levels: sums over blocks of batches first, one task's work for a row
    of each block, then within each block.
    """
    rows = layout.withColumn("_block", F.floor(F.col("batch") / block)).withColumn("_r", F.col("width").cast("long") * lanes).withColumn("_c", (F.col("width").cast("long") + 1) * 2 * lanes)
    run = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0)).cast("long")
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("_block").agg(F.sum("_r").alias("_all_r"), F.sum("_c").alias("_all_c"))
    blocks = blocks.select("_block", run("_all_r", before).alias("_base_r"), run("_all_c", before).alias("_base_c"))
    inner = Window.partitionBy("_block").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("_in_r", run("_r", inner)).withColumn("_in_c", run("_c", inner)).join(blocks, "_block")
    return out.select(*layout.columns, (F.col("_base_r") + F.col("_in_r")).alias("residue_start"), (F.col("_base_c") + F.col("_in_c")).alias("row_start"))


def _budget_plan(counts: DataFrame, query_len: int, budget: int) -> DataFrame:
    """(_len, base, n0, b0, per, b1) of each length: its first place, how many of it end batch b0, and how many go to each batch from b1 on."""

    def plan(batches):
        base, batch, used = 0, 0, 0
        for t in batches:
            out = []
            for n, count in zip(t.column("_len").to_pylist(), t.column("n").to_pylist(), strict=True):
                cells = 3 * (query_len + 1) * ((n or 0) + 1)
                per = max(1, budget // cells)
                n0 = min(count, (budget - used) // cells if used else per) if used <= budget else 0
                b0, rest = batch, count - n0
                used += n0 * cells
                if rest:
                    batch += 1
                    b1, more = batch, -(-rest // per) - 1
                    batch += more
                    used = (rest - more * per) * cells
                else:
                    b1 = batch
                out.append((n, base, n0, b0, per, b1))
                base += count
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["_len", "base", "n0", "b0", "per", "b1"])

    one = counts.repartition(1).sortWithinPartitions(F.asc_nulls_last("_len"))
    return one.mapInArrow(plan, "_len int, base long, n0 long, b0 long, per long, b1 long")


def budget_batches(df: DataFrame, query_len: int, budget: int, key: str = "target_id") -> DataFrame:
    """Adds budget_batch: sequences in length order, a batch closed before its score matrices exceed ``budget`` cells.

    Greedy over the whole length order, with at least one sequence to a batch.
    Costs depend on the length alone, so the sequential part goes over one row
    for each different length and not over sequences; each sequence finds its
    batch from its place.  The result does not depend on partitions.
    """
    counts = df.groupBy(F.col("len").cast("int").alias("_len")).agg(F.count("*").alias("n"))
    rows = positioned(df, key).join(_budget_plan(counts, query_len, budget), F.col("len").eqNullSafe(F.col("_len")))
    place = F.col("ord") - F.col("base")
    later = F.col("b1") + F.floor((place - F.col("n0")) / F.col("per"))
    return rows.select(*df.columns, F.when(place < F.col("n0"), F.col("b0")).otherwise(later).cast("long").alias("budget_batch"))


def largest_allocation(batches: DataFrame) -> DataFrame:
    """(batches, columns, alignments): how many budget batches, and the most columns (residues and borders) and sequences of one."""
    each = batches.groupBy("budget_batch").agg(F.sum(F.coalesce(F.col("len").cast("long"), F.lit(0)) + 1).alias("columns"), F.count("*").alias("alignments"))
    return each.agg(F.count("*").alias("batches"), F.max("columns").alias("columns"), F.max("alignments").alias("alignments"))


def overflow_risk(df: DataFrame, query_len: int, limit: int = 30000, lanes: int = LANES, top: int = 11, open_: int = 10, extend: int = 1) -> DataFrame:
    """(batch, local, whole): whether some sequence's score (local) or border (global) could pass the narrow limit."""
    high = F.least(F.col("len"), F.lit(query_len)) * top >= limit
    border = F.greatest(F.col("len"), F.lit(query_len)) + (open_ - extend) >= limit
    return batch_of(df, lanes).groupBy("batch").agg(F.bool_or(high).alias("local"), F.bool_or(high | border).alias("whole"))
