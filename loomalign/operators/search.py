"""Search of a database with one or many queries: a score for every pair."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomalign.functions.scoring import GAP_EXTEND, GAP_OPEN, MATRIX, MAX_QUERY, algorithm_name, encode, encode_all
from loomalign.operators import kernels
from loomalign.operators.layout import n_shortest, routed
from loomalign.operators.many import search_many

SCORES = "query_id string, target_id long, algorithm string, len int, route string, score int"
#: Residues of queries that go out with the tasks at once; more queries are taken in turns.
QUERY_BLOCK = 1 << 20
#: Bytes of targets that a task holds at a time, and what one of them takes besides its residues.
HELD, EACH = 1 << 26, 1024


#: Bytes to a task below which a database is dealt anew.
SMALL = 1 << 24


def _bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the size, without running anything."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """Targets dealt over all tasks where a scan would give each less than ``SMALL`` bytes, or over ``partitions``."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if not partitions and (rows.isStreaming or _bytes(rows) < SMALL * tasks):
        partitions = tasks
    return rows.repartition(partitions, "target_id") if partitions else rows


def _checked(query: str, max_query: int | None) -> np.ndarray:
    codes = encode(query)
    if max_query is not None and len(codes) > max_query:
        raise ValueError(f"the query has {len(codes)} residues; the limit is {max_query}")
    return codes


def _scored(targets: DataFrame, queries: list[tuple[str, np.ndarray]], algorithm: str, threshold: int, engine: str, open_: int, extend: int, matrix: np.ndarray) -> DataFrame:
    sent = targets.sparkSession.sparkContext.broadcast(queries)

    def solve(q, seqs):
        if engine == "scalar":
            return np.array([kernels.scalar(algorithm, q, t, open_, extend, matrix) for t in seqs], np.int64)
        return kernels.scores(algorithm, q, seqs, threshold, open_, extend, engine == "wide", matrix)

    def out(ids, seqs, lens, routes):
        for name, q in sent.value:
            score = solve(q, seqs)
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(ids, pa.int64()), pa.array([algorithm] * n), pa.array(lens, pa.int32()), pa.array(routes, pa.string()), pa.array(score.astype(np.int32))], ["query_id", "target_id", "algorithm", "len", "route", "score"])

    def run(batches):
        ids, seqs, lens, routes, held = [], [], [], [], 0
        for batch in batches:
            codes = encode_all(batch.column("seq"))
            ids += batch.column("target_id").to_pylist()
            lens += batch.column("len").to_pylist()
            routes += batch.column("route").to_pylist()
            seqs += codes
            held += sum(map(len, codes)) + EACH * len(codes)
            # Batches of like length need many sequences at hand.
            if held > HELD:
                yield from out(ids, seqs, lens, routes)
                ids, seqs, lens, routes, held = [], [], [], [], 0
        if ids:
            yield from out(ids, seqs, lens, routes)

    return targets.select("target_id", "seq", "len", "route").mapInArrow(run, SCORES)


def search(
    targets: DataFrame,
    query: str | dict[str, str] | DataFrame,
    algorithm: str = "sw",
    threshold: int = 4096,
    num_seqs: int | None = None,
    engine: str = "vector",
    max_query: int | None = MAX_QUERY,
    gap_open: int = GAP_OPEN,
    gap_extend: int = GAP_EXTEND,
    partitions: int | None = None,
    matrix: np.ndarray = MATRIX,
) -> DataFrame:
    """Scores (query_id, target_id, algorithm, len, route, score) of targets (target_id, seq, len).

    num_seqs limits the search to the shortest targets before any is scored.
    From ``threshold`` residues on a target takes the kernel for single long
    sequences; the score does not depend on it.  A null sequence has a null
    score.  engine: vector, scalar (the definition) or native (expressions only,
    for short sequences).

    matrix: scores by the codes of query and target (``scoring.read_matrix``); the
    kernels' bounds and widths follow from it.

    Queries given as a table (query_id, seq) are never gathered: blocks of them
    meet splits of the targets (``many.search_many``); the engine is then vector.

    Costs of a target are its residues times the query's.  Targets are scored
    where they are read; below ``SMALL`` bytes to a task, or where ``partitions``
    is given, they are first dealt by hash of the id, so that lengths mix and no
    task gets all long ones.
    """
    algorithm_name(algorithm)
    if num_seqs is not None and num_seqs <= 0:
        raise ValueError("num_seqs is a positive number")
    if gap_open < gap_extend:
        raise ValueError("opening a gap costs at least as much as extending it")
    if isinstance(query, DataFrame):
        if engine != "vector":
            raise ValueError("queries in a table are scored by the vector engine")
        rows = targets if num_seqs is None else n_shortest(targets.where("seq is not null"), num_seqs)
        found = search_many(rows, query, algorithm, threshold, max_query, gap_open, gap_extend, matrix=matrix)
        return routed(found, threshold).withColumn("route", F.when(F.col("len").isNotNull(), F.col("route"))).select("query_id", "target_id", "algorithm", "len", "route", "score")
    queries = query if isinstance(query, dict) else {"query": query}
    coded = [(name, _checked(q, max_query)) for name, q in queries.items()]
    rows = targets.where("seq is not null")
    if num_seqs is not None:
        rows = n_shortest(rows, num_seqs)
    rows = routed(rows.select("target_id", "seq", "len"), threshold)
    if engine == "native":
        from loomalign.operators.native import native_scores

        return native_scores(rows, queries, algorithm, gap_open, gap_extend, matrix)
    dealt = spread(rows, partitions)
    # Queries go out in blocks of a bounded size; each block is a pass over the same rows.
    blocks, size = [[]], 0
    for item in coded:
        if blocks[-1] and size + len(item[1]) > QUERY_BLOCK:
            blocks.append([])
            size = 0
        blocks[-1].append(item)
        size += len(item[1])
    found = None
    for block in blocks:
        part = _scored(dealt, block, algorithm, threshold, engine, gap_open, gap_extend, matrix)
        found = part if found is None else found.unionByName(part)
    nulls = targets.where("seq is null")
    for name in queries if num_seqs is None else ():
        empty = nulls.select(F.lit(name).alias("query_id"), "target_id", F.lit(algorithm).alias("algorithm"), F.lit(None).cast("int").alias("len"), F.lit(None).cast("string").alias("route"), F.lit(None).cast("int").alias("score"))
        found = found.unionByName(empty)
    return found


def self_scores(targets: DataFrame) -> DataFrame:
    """(target_id, score) of each target aligned locally with itself; equal sequences are aligned once, a null one has a null score.

    Scores find their targets by 128 bits of hashes, so no sequence is a join's key.
    """
    hashed = lambda seed: F.when(F.col("seq").isNotNull(), F.xxhash64(F.lit(seed), "seq"))
    keyed = targets.select("target_id", "seq", hashed(1).alias("_ka"), hashed(2).alias("_kb"))

    def run(batches):
        for batch in batches:
            score = [int(kernels.within("sw", c, c)) for c in encode_all(batch.column("seq"))]
            yield pa.RecordBatch.from_arrays([batch.column("_ka"), batch.column("_kb"), pa.array(score, pa.int64())], ["_ka", "_kb", "score"])

    once = keyed.where("seq is not null").groupBy("_ka", "_kb").agg(F.first("seq").alias("seq"))
    scores = once.mapInArrow(run, "_ka long, _kb long, score long")
    return keyed.join(scores, ["_ka", "_kb"], "left").select("target_id", "score")


def top_hits(scores: DataFrame, k: int) -> DataFrame:
    """Extension: (query_id, rank, target_id, len, score) of the k best targets of each query; equal scores by id.

    A rank with a limit: each task keeps its own k before anything is shuffled.
    """
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "target_id")
    ranked = scores.where("score is not null").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "target_id", "len", "score")


def routes_apart(targets: DataFrame, query: str | dict[str, str], algorithm: str = "sw", threshold: int = 4096, **options) -> DataFrame:
    """The two routes scored as two jobs and put together again: where long targets want a cluster's own settings.

    ``search`` scores both in one pass; the scores are the same.
    """
    rows = routed(targets, threshold)
    small = search(rows.where("route = 'small'").drop("route"), query, algorithm, threshold, **options)
    large = search(rows.where("route = 'large'").drop("route"), query, algorithm, threshold, **options)
    return small.unionByName(large)


def with_redo(first: DataFrame, redo: DataFrame, keys: tuple[str, ...] = ("query_id", "target_id")) -> DataFrame:
    """``first`` with the scores of ``redo`` where that has them."""
    again = redo.select(*keys, F.col("score").alias("_again"))
    return first.join(again, list(keys), "left").withColumn("score", F.coalesce("_again", "score")).drop("_again").select(*first.columns)


def _flagged(longest: int, algorithm: str, limit: int, gap_open: int, gap_extend: int, matrix: np.ndarray = MATRIX):
    """Whether the bound that the kernels keep to lets some cell of a target leave the narrow type."""
    top = kernels.top_of(matrix) * (F.least(F.col("len"), F.lit(longest)) + 1)
    low = 4 * gap_open + (F.col("len") + longest + 1) * gap_extend
    return F.coalesce((top >= limit) | ((low >= limit) if algorithm == "nw" else F.lit(False)), F.lit(False))


def narrow_first(targets: DataFrame, query: str | dict[str, str], algorithm: str = "sw", limit: int | None = None, threshold: int = 4096, **options) -> DataFrame:
    """Scores in two steps: all targets whose cells a narrow type surely holds, then the others by the wide kernels.

    The first step leaves the flagged targets blank, the second one's scores are
    put in their places.  The kernels choose the width by the same bound for
    each batch, so ``search`` needs no second step; this keeps the two apart
    where the flagged ones are of interest.  Gap costs and all other options
    hold for both.
    """
    queries = query if isinstance(query, dict) else {"query": query}
    longest = max(len(q.encode()) for q in queries.values())
    costs = options.get("gap_open", GAP_OPEN), options.get("gap_extend", GAP_EXTEND)
    if (n := options.pop("num_seqs", None)) is not None:
        if n <= 0:
            raise ValueError("num_seqs is a positive number")
        targets = n_shortest(targets.where("seq is not null"), n)
    flag = _flagged(longest, algorithm, limit or kernels.NARROW_LIMIT, *costs, options.get("matrix", MATRIX))
    first = search(targets.where(~flag), queries, algorithm, threshold, **options)
    late = targets.where(flag)
    names = F.explode(F.array(*map(F.lit, queries))).alias("query_id")
    blank = routed(late.select("target_id", "len", names), threshold).withColumn("algorithm", F.lit(algorithm)).withColumn("score", F.lit(None).cast("int"))
    return with_redo(first.unionByName(blank), search(late, queries, algorithm, threshold, **options | {"engine": "wide"}))
