"""Many queries against many targets: both sides distributed, blocks of queries against splits of targets.

Neither side passes through the driver.  Rows of both are dealt by hash into blocks
of about so many residues; each pair of a query block and a target split is one
group that a task scores, so a group's memory is that of two blocks and its cost
the product of their sizes.  A row goes once to every block of the other side,
which is all that a comparison of all with all can do.  There are at least about as
many groups as the session has shuffle partitions, so small tables are many tasks
too, and groups are dealt by an explicit number of partitions: their cost is in
cells and not in bytes, by which small partitions would be merged.  Where both sides are one
table, each unordered pair is scored once, by symmetry, in the group of its two
blocks, and given both ways round.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomalign.functions.scoring import GAP_EXTEND, GAP_OPEN, MATRIX, MAX_QUERY, algorithm_name, encode
from loomalign.operators import kernels

#: Residues of a query block and of a target split: some 6 * 10^10 cells to a group.
QUERY_RESIDUES, TARGET_RESIDUES = 1 << 16, 1 << 20
SCORES = "query_id string, target_id long, algorithm string, len int, score int"


#: Most partitions that groups are dealt over.
_PARTITIONS = 20_000


def _blocks(rows: DataFrame, residues: int, least: int = 1) -> int:
    """Into how many blocks of about so many residues the rows go, ``least`` of them if there are as many rows; a row counts as one more than its residues."""
    size = rows.agg(F.sum(F.coalesce(F.octet_length("seq"), F.lit(0)).cast("long") + 1).alias("residues"), F.count("*").alias("n")).first()
    return max(1, -(-(size.residues or 0) // residues), min(least, size.n))


def _tasks(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _dealt(rows: DataFrame, key: str, own: int, other: int, mine: str, theirs: str) -> DataFrame:
    """Each row in a block of its own side, once for every block of the other."""
    return rows.withColumn(mine, F.pmod(F.xxhash64(key), F.lit(own)).cast("int")).withColumn(theirs, F.explode(F.sequence(F.lit(0), F.lit(other - 1))))


def _table(columns: dict) -> pa.Table:
    kinds = {"query_id": pa.string(), "target_id": pa.int64(), "algorithm": pa.string(), "len": pa.int32(), "score": pa.int32()}
    return pa.table({name: pa.array(columns[name], kind) for name, kind in kinds.items()})


def _score(algorithm: str, q: np.ndarray | None, seqs: list, threshold: int, open_: int, extend: int, matrix: np.ndarray = MATRIX) -> list:
    """Scores of one query; null where either side is."""
    if q is None:
        return [None] * len(seqs)
    there = [i for i, s in enumerate(seqs) if s is not None]
    out: list = [None] * len(seqs)
    for i, v in zip(there, kernels.scores(algorithm, q, [seqs[i] for i in there], threshold, open_, extend, False, matrix).tolist(), strict=True):
        out[i] = v
    return out


def _codes(column) -> list:
    return [None if s is None else encode(s) for s in column.to_pylist()]


def _limited(queries: DataFrame, max_query: int | None) -> DataFrame:
    if max_query is None:
        return queries
    n = F.octet_length("seq")
    message = F.concat(F.lit("a query has "), n.cast("string"), F.lit(f" residues; the limit is {max_query}"))
    return queries.withColumn("seq", F.when(n > max_query, F.raise_error(message)).otherwise(F.col("seq")))


def search_many(targets: DataFrame, queries: DataFrame, algorithm: str = "sw", threshold: int = 4096, max_query: int | None = MAX_QUERY, gap_open: int = GAP_OPEN, gap_extend: int = GAP_EXTEND, query_residues: int = QUERY_RESIDUES, target_residues: int = TARGET_RESIDUES, matrix: np.ndarray = MATRIX) -> DataFrame:
    """``SCORES`` of every row of queries (query_id, seq) with every row of targets (target_id, seq).

    A null sequence on either side has a null score with all of the other; a
    query over ``max_query`` residues fails the job.
    """
    algorithm_name(algorithm)
    if gap_open < gap_extend:
        raise ValueError("opening a gap costs at least as much as extending it")
    q = _limited(queries.select(F.col("query_id").cast("string").alias("name"), "seq"), max_query)
    t = targets.select(F.col("target_id").cast("long").alias("id"), "seq")
    nq = _blocks(q, query_residues)
    nt = _blocks(t, target_residues, -(-2 * _tasks(t) // nq))
    asked = _dealt(q, "name", nq, nt, "_q", "_t").select("_q", "_t", "name", F.lit(None).cast("long").alias("id"), F.lit(True).alias("_asks"), "seq")
    given = _dealt(t, "id", nt, nq, "_t", "_q").select("_q", "_t", F.lit(None).cast("string").alias("name"), "id", F.lit(False).alias("_asks"), "seq")

    def solve(group):
        asks = group.column("_asks").combine_chunks()
        mine, theirs = group.filter(asks), group.filter(pa.array(~np.asarray(asks.to_numpy(zero_copy_only=False), bool)))
        seqs, ids = _codes(theirs.column("seq")), theirs.column("id").to_pylist()
        lens = [None if s is None else len(s) for s in seqs]
        out: dict[str, list] = {"query_id": [], "target_id": [], "algorithm": [], "len": [], "score": []}
        for name, code in zip(mine.column("name").to_pylist(), _codes(mine.column("seq")), strict=True):
            out["query_id"] += [name] * len(ids)
            out["target_id"] += ids
            out["len"] += lens
            out["score"] += _score(algorithm, code, seqs, threshold, gap_open, gap_extend, matrix)
        out["algorithm"] = [algorithm] * len(out["query_id"])
        return _table(out)

    both = asked.unionByName(given).repartition(min(nq * nt, _PARTITIONS), "_q", "_t")
    return both.groupBy("_q", "_t").applyInArrow(solve, SCORES)


def all_pairs(rows: DataFrame, algorithm: str = "sw", threshold: int = 4096, gap_open: int = GAP_OPEN, gap_extend: int = GAP_EXTEND, residues: int = 1 << 18, matrix: np.ndarray = MATRIX) -> DataFrame:
    """(a, b, score) of every ordered pair of rows (target_id, seq), also of each with itself; each unordered pair is scored once.

    Both algorithms are symmetric where the matrix is; another matrix is an error.  A null
    sequence has a null score with all rows.  Repeated ids are rows of their own.
    """
    algorithm_name(algorithm)
    if gap_open < gap_extend:
        raise ValueError("opening a gap costs at least as much as extending it")
    if (matrix != matrix.T).any():
        raise ValueError("pairs are scored once, so the matrix has to be symmetric")
    t = rows.select(F.col("target_id").cast("long").alias("id"), "seq")
    n = _blocks(t, residues, math.isqrt(4 * _tasks(t)))
    dealt = _dealt(t, "id", n, n, "_own", "_other")
    pairs = dealt.select(F.least("_own", "_other").alias("_p"), F.greatest("_own", "_other").alias("_o"), "_own", "id", "seq")

    def solve(key, group):
        p, o = key[0].as_py(), key[1].as_py()
        own = group.column("_own").to_numpy()
        ids, codes = group.column("id").to_pylist(), _codes(group.column("seq"))
        # Longest first: each meets those that are no longer than itself.
        order = sorted(range(len(ids)), key=lambda i: -1 if codes[i] is None else len(codes[i]), reverse=True)
        a, b, s = [], [], []
        for k, i in enumerate(order):
            others = order[k:] if p == o else [j for j in order if own[j] == o] if own[i] == p else []
            if not others:
                continue
            score = _score(algorithm, codes[i], [codes[j] for j in others], threshold, gap_open, gap_extend, matrix)
            # Both ways round, itself once.
            both = [x for x, j in enumerate(others) if j != i]
            a += [ids[i]] * len(others) + [ids[others[x]] for x in both]
            b += [ids[j] for j in others] + [ids[i]] * len(both)
            s += score + [score[x] for x in both]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "score": pa.array(s, pa.int32())})

    dealt = pairs.repartition(min(n * (n + 1) // 2, _PARTITIONS), "_p", "_o")
    return dealt.groupBy("_p", "_o").applyInArrow(solve, "a long, b long, score int")
