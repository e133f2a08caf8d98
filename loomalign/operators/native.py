"""Alignment scores by expressions alone: an anti-diagonal fold over arrays, for short sequences and as a check."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomalign.functions.scoring import GAP_EXTEND, GAP_OPEN, MATRIX, encode, encode_column

_NEG = -(1 << 29)


def native_scores(rows: DataFrame, queries: dict[str, str], algorithm: str, open_: int = GAP_OPEN, extend: int = GAP_EXTEND, matrix: np.ndarray = MATRIX) -> DataFrame:
    """As ``search``.  A score depends on the sequence alone, so equal sequences are folded once.

    The different ones are dealt over all tasks (a scan of short sequences has few),
    and scores find their targets by a join on the sequence.
    """
    codes = encode_column(F.col("seq")).cast("array<int>")
    folded = F.array(*(_folded(encode(q), algorithm, open_, extend, matrix).cast("int") for q in queries.values()))
    coded = lambda seqs: seqs.withColumn("codes", codes).withColumn("n", F.size("codes"))
    if rows.isStreaming:
        scored = coded(rows).withColumn("_scores", folded)
    else:
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        once = coded(rows.select("seq").distinct()).repartition(tasks).select("seq", folded.alias("_scores"))
        scored = rows.join(once, "seq")
    # Names are exploded and not scores, of which the optimizer would make a filter that computes them for every row.
    named = scored.withColumn("_k", F.explode(F.array(*map(F.lit, range(len(queries))))))
    names = F.array(*map(F.lit, queries))
    return named.select(names[F.col("_k")].alias("query_id"), "target_id", F.lit(algorithm).alias("algorithm"), "len", "route", F.col("_scores")[F.col("_k")].alias("score"))


def _folded(q: np.ndarray, algorithm: str, open_: int, extend: int, matrix: np.ndarray) -> Column:
    """The score of the query with ``codes``, ``n`` of them.

    Cell j of diagonal d is row d - j of the query, column j of the target, with
    columns 0 to n; cells outside the table hold minus infinity.  The state of the
    fold lies as the next diagonal needs it: x and y are what a cell gets from a gap
    down the query and along the target, c and b the cells before it by one and by
    two diagonals, y, c and b moved by a column.
    """
    local = algorithm == "sw"
    m = len(q)
    n, neg = F.col("n"), F.lit(_NEG)
    border = lambda k: F.when(k == 0, 0).otherwise(F.lit(0) if local else -(F.lit(open_) + (k - 1) * extend))
    if m == 0:
        return F.lit(0) if local else border(n)
    of_query = F.array(*(F.array(*(F.lit(int(v)) for v in matrix[c])) for c in q))
    moved = lambda cells: F.concat(F.array(neg), F.slice(cells, F.lit(1), n))

    def step(s, d):
        def cell(j):
            i = d - j
            met = s["b"][j] + of_query[i - 1][F.col("codes")[j - 1]]
            inside = F.greatest(met, s["x"][j], s["y"][j], *([F.lit(0)] if local else []))
            return F.when((i >= 1) & (j >= 1) & (i <= m), inside).when((i == 0) | ((j == 0) & (i <= m)), border(d)).otherwise(neg)

        def state(h):
            gap = lambda before: F.zip_with(h, before, lambda v, g: F.greatest(v - open_, g - extend))
            best = F.greatest(s["best"], F.array_max(h)) if local else F.element_at(h, -1)
            return F.struct(gap(s["x"]).alias("x"), moved(gap(s["y"])).alias("y"), s["c"].alias("b"), moved(h).alias("c"), best.alias("best"))

        # An array of one, so that the cells of the diagonal have a name and are computed once.
        return F.transform(F.array(F.transform(F.sequence(F.lit(0), n), cell)), state)[0]

    blank = F.array_repeat(neg, n + 1)
    first = F.concat(F.array(F.lit(0)), F.array_repeat(neg, n))
    start = F.struct(blank.alias("x"), blank.alias("y"), blank.alias("b"), moved(first).alias("c"), F.lit(0).alias("best"))
    return F.aggregate(F.sequence(F.lit(1), n + m), start, step, lambda s: s["best"])
