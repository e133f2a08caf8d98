"""Alignment of massive pairs: one pair over many tasks.

The matrix of a pair is cut into tiles of ``side`` residues of the query by
``side`` of the target.  A tile needs the cells along its upper and its left edge
and gives those along its lower and its right one; so all tiles of an
anti-diagonal, of all pairs, are a round of independent tasks.  Between rounds
edges alone are kept, two numbers a residue, as rows of a table in the shared
folder: a round never repeats an earlier one, whatever executors are lost, and a
task's memory depends on the tile and not on the pair.  A pair of m and n
residues takes (m + n) / side rounds with up to min(m, n) / side tiles each.

A task aligns some tiles side by side, see ``lanes``; gap costs too high for that
take a kernel that goes by rows of one tile as ``kernels.within`` does, a band of
rows after the other, cells relative to the band's corner.  Pairs of equal texts
are aligned once, and a text with itself not at all: its score is that of its
residues.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomalign.functions.scoring import GAP_EXTEND, GAP_OPEN, MATRIX, algorithm_name, encode
from loomalign.operators.kernels import TOP
from loomalign.operators.lanes import COLUMNS, Tile, align, groups
from loomalign.sources.staged import drop, staged

#: Residues of a tile's sides: wide, so that rounds are few and rows long, and some MB in memory.
SIDE = 16_384
#: Tiles of a task: one group or, globally, two of like height.
TILES = 16
#: Rows that share a corner.
BAND = 512
#: Places that a running maximum takes by doubling; before whole blocks of them stands one maximum each.
_BLOCK = 128
#: What a cell of 16 bits may reach.
_NARROW = 32_000
#: The lowest score of the matrix: a cell is at least its diagonal neighbour less this.
_LOW = int(-MATRIX.min())
_NONE = -(1 << 60)


def outer_edge(local: bool, start: int, n: int, open_: int = GAP_OPEN, extend: int = GAP_EXTEND) -> tuple[np.ndarray, np.ndarray]:
    """(h, g) of n residues from ``start`` on along the outside of a matrix; h has the corner before them too."""
    k = np.arange(start, start + n + 1, dtype=np.int64)
    h = np.zeros(n + 1, np.int64) if local else -np.where(k > 0, open_ + (k - 1) * extend, 0)
    return h, h[1:] - open_


def _running(x: np.ndarray, spare: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(maximum of each place and all before it, an array to spare); if no more matters, of ``reach`` places at least.

    By vectors: ``np.maximum.accumulate`` goes place by place.
    """
    n = len(x)
    if n < 8 * _BLOCK and reach > _BLOCK:
        np.maximum.accumulate(x, out=x)
        return x, spare
    k = 1
    while k < min(reach, _BLOCK, n):
        spare[:k] = x[:k]
        np.maximum(x[k:], x[:-k], out=spare[k:])
        x, spare = spare, x
        k *= 2
    if reach > _BLOCK:
        whole = n // _BLOCK * _BLOCK
        before = np.maximum.accumulate(x[_BLOCK - 1 : whole : _BLOCK])
        blocks = x[_BLOCK:whole].reshape(-1, _BLOCK)
        np.maximum(blocks, before[:-1, None], out=blocks)
        np.maximum(x[whole:], before[-1], out=x[whole:])
    return x, spare


def tile(q: np.ndarray, t: np.ndarray, top: tuple, left: tuple, local: bool, open_: int = GAP_OPEN, extend: int = GAP_EXTEND, wide: bool = False) -> tuple[tuple, tuple, int]:
    """(lower edge, right edge, best cell) of a tile from its upper and left edges.

    An edge is (h, g): the cells along it, beginning with the corner, and the
    gap across it that each row or column behind it starts with.
    """
    m, n = len(q), len(t)
    base = int(top[0][0])
    edges = [top[0] - base, top[1] - base, left[0] - base, left[1] - base]
    high = max(int(e.max()) for e in edges) + TOP * min(m, n)
    # Gaps along the target are lifted by their column for the running maximum.
    low = min(int(e.min()) for e in edges) - 2 * open_ - (m + n) * extend - _LOW
    narrow = not wide and high + n * extend + open_ < _NARROW and -low < _NARROW
    kind = np.int16 if narrow else np.int32 if max(high, -low) + n * extend < 1 << 30 else np.int64
    h, f, side_h, side_g = (e.astype(kind) for e in edges)
    h = h.copy()
    f = f + kind(extend)  # each row begins by extending
    profile = np.take(MATRIX.astype(kind), t.astype(np.intp), 1, mode="clip")
    steps = (np.arange(n + 1) * extend).astype(kind)
    opened = steps + kind(open_)
    opening, extending = kind(open_), kind(extend)
    # What is 0 in a local alignment; where it lies below all cells it does nothing.
    floor = np.full(n, max(-base, low), kind) if local else None
    # The highest cell of the row before, or value that comes in from the left.
    entering = max(int(edges[2].max()), int(edges[3].max()) + open_) if local else 0
    peak = int(edges[0].max()) if local else 0
    other = np.empty(n, kind)
    right_h, right_g = np.empty(m + 1, kind), np.empty(m, kind)
    right_h[0] = h[n]
    p, x = np.empty(n + 1, kind), np.empty(n, kind)
    most = _NONE
    for i in range(m):
        np.subtract(f, extending, out=f)
        if i:
            np.subtract(h[1:], opening, out=x)
            np.maximum(f, x, out=f)
        np.add(h[:-1], profile[q[i]], out=p[1:])
        np.maximum(p[1:], f, out=p[1:])
        if local:
            np.maximum(p[1:], floor, out=p[1:])
        p[0] = side_g[i] + opening  # the gap that comes in from the left, as if it opened there
        np.add(p[:-1], steps[:-1], out=x)
        # A local gap that has fallen to 0 is of no use, so none is longer than this.
        reach = (max(peak + TOP, entering) - int(floor[0]) - open_) // extend + 1 if local and extend else n
        x, other = _running(x, other, reach)
        np.subtract(x, opened[:-1], out=x)
        h[0] = side_h[i + 1]
        np.maximum(p[1:], x, out=h[1:])
        right_h[i + 1] = h[n]
        right_g[i] = max(int(h[n]) - open_, int(x[n - 1]) - extend)
        if local:
            peak = int(h.max())
            most = max(most, peak)
    down = np.maximum(f - extending, h[1:] - opening)
    up = lambda a: a.astype(np.int64) + base
    best = most + base if local else 0
    return (up(h), up(down)), (up(right_h), up(right_g)), best


def banded(q: np.ndarray, t: np.ndarray, top: tuple, left: tuple, local: bool, open_: int = GAP_OPEN, extend: int = GAP_EXTEND, wide: bool = False, band: int = BAND) -> tuple[tuple, tuple, int]:
    """As ``tile``, in bands of rows that each have a corner of their own."""
    right_h, right_g, best = [top[0][-1:]], [], _NONE
    for a in range(0, len(q), band):
        part = q[a : a + band]
        top, right, most = tile(part, t, top, (left[0][a : a + len(part) + 1], left[1][a : a + len(part)]), local, open_, extend, wide)
        right_h.append(right[0][1:])
        right_g.append(right[1])
        best = max(best, most)
    return top, (np.concatenate(right_h), np.concatenate(right_g)), best


_EDGES = "pair long, kind string, at int, first long, h binary, g binary, score long"


def packed(edge: tuple[np.ndarray, np.ndarray]) -> tuple[int, bytes, bytes]:
    """An edge as its corner, the steps along it and the drops to its gaps, a byte each where they fit."""
    h, g = edge
    both = np.diff(h), h[1:] - g
    kind = np.int8 if all(not len(x) or (x.min() >= -128 and x.max() < 128) for x in both) else np.int64
    return int(h[0]), *(x.astype(kind).tobytes() for x in both)


def unpacked(first: int, steps: bytes, drops: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    steps, drops = (np.frombuffer(x, np.int8 if len(x) == n else np.int64).astype(np.int64) for x in (steps, drops))
    h = np.cumsum(np.concatenate(([first], steps)))
    return h, h[1:] - drops


def with_itself(q: np.ndarray, local: bool) -> int:
    """The score of a text with itself, where a gap costs at least its residues.

    No two residues score more than the mean of what each scores with itself, and
    that is no less than -1: leaving one out for a gap gains nothing.
    """
    own = MATRIX.diagonal()[q].astype(np.int64)
    if not local:
        return int(own.sum())
    sums = np.concatenate(([0], np.cumsum(own)))
    return int((sums - np.minimum.accumulate(sums)).max())


def _cut(pairs: DataFrame, column: str, length: str, name: str, side: int) -> DataFrame:
    """(pair, name, residues): each sequence in stretches of ``side`` bytes."""
    blocks = F.sequence(F.lit(0), F.floor((F.col(length) - 1) / side).cast("int"))
    rows = pairs.select("pair", F.encode(column, "utf-8").alias("_all"), F.explode(blocks).alias(name))
    return rows.select("pair", name, F.substring(F.col("_all"), F.col(name) * side + 1, F.lit(side)).alias(f"{name}_seq"))


def massive_pairs(pairs: DataFrame, algorithm: str = "sw", side: int = SIDE, gap_open: int = GAP_OPEN, gap_extend: int = GAP_EXTEND, tasks: int | None = None, wide: bool = False) -> DataFrame:
    """(pair, score) of pairs (pair, query, target), each aligned by tiles over many tasks.

    ``pair`` is a different number for each row.  An empty sequence has the
    score of its border, a null one a null score.
    """
    local = algorithm_name(algorithm) == "sw"
    if gap_open < gap_extend:
        raise ValueError("opening a gap costs at least as much as extending it")
    if side < 1:
        raise ValueError("the side of a tile is a positive number")
    spark = pairs.sparkSession
    cores = tasks or spark.sparkContext.defaultParallelism
    # Pairs of equal texts have equal hashes, 128 bits of each text.
    named = F.struct(*(F.xxhash64(F.lit(k), c).alias(f"{c}{k}") for c in ("query", "target") for k in (1, 2)))
    sized = pairs.select(F.col("pair").cast("long").alias("pair"), "query", "target", F.octet_length("query").alias("m"), F.octet_length("target").alias("n"), named.alias("texts"))
    sized = staged(sized, "pairs")
    first = sized.where("m > 0 and n > 0").groupBy("texts", "m", "n").agg(F.min("pair").alias("pair"))
    different = sized.join(first.select("pair"), "pair", "left_semi")
    same = F.lit(gap_extend >= 1) & (F.col("query") == F.col("target"))
    whole = different.where(~same)
    grid = sized.select("pair", F.ceil(F.col("m") / side).cast("int").alias("rows"), F.ceil(F.col("n") / side).cast("int").alias("columns"))
    # How many tiles each anti-diagonal has.
    shapes = whole.select("pair").join(grid, "pair").groupBy("rows", "columns").agg(F.count("*").alias("pairs"))
    rounds = shapes.select("pairs", "rows", "columns", F.explode(F.sequence(F.lit(0), F.col("rows") + F.col("columns") - 2)).alias("d"))
    tiles_of = F.least(F.col("d"), F.col("rows") - 1) - F.greatest(F.lit(0), F.col("d") - F.col("columns") + 1) + 1
    counts = [r.tiles for r in rounds.groupBy("d").agg(F.sum(F.col("pairs") * tiles_of).alias("tiles")).orderBy("d").collect()]
    gap = lambda k: -(F.lit(gap_open) + (k - 1) * gap_extend)
    border = F.when(F.col("m").isNull() | F.col("n").isNull(), F.lit(None)).when(F.lit(local) | ((F.col("m") == 0) & (F.col("n") == 0)), F.lit(0)).otherwise(gap(F.greatest("m", "n")))
    plain = sized.where("m is null or n is null or m = 0 or n = 0").select("pair", border.cast("long").alias("score"))

    def themselves(batches):
        for batch in batches:
            found = [with_itself(encode(q), local) for q in batch.column("query").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("pair"), pa.array(found, pa.int64())], ["pair", "score"])

    scored = different.where(same).select("pair", "query").mapInArrow(themselves, "pair long, score long")
    q_parts, t_parts = staged(_cut(whole, "query", "m", "r", side), "query"), staged(_cut(whole, "target", "n", "c", side), "target")

    def solve(batches):
        names = [f"{kind}_{x}" for kind in ("top", "left") for x in ("first", "h", "g")]
        for batch in batches:
            rows, tiles = batch.drop_columns(["r_seq", "c_seq"]).to_pylist(), []
            for i, row in enumerate(rows):
                q, t = (encode(batch.column(x)[i].as_py()) for x in ("r_seq", "c_seq"))
                edge = lambda kind, k, n: outer_edge(local, k * side, n, gap_open, gap_extend) if row[f"{kind}_h"] is None else unpacked(*(row[x] for x in names if x.startswith(kind)), n)  # noqa: E731, B023
                tiles.append(Tile(q, t, edge("top", row["c"], len(t)), edge("left", row["r"], len(q))))
            of = {id(x): row for x, row in zip(tiles, rows, strict=True)}
            for group in groups(tiles, COLUMNS * 2 if local else COLUMNS):
                beside = any(of[id(x)]["c"] < of[id(x)]["columns"] - 1 for x in group)
                edges = [(x.lower, x.left) for x in group]
                if align(group, local, gap_open, gap_extend, wide, beside):
                    done = [(x.lower, x.right if beside else None, x.best) for x in group]
                else:
                    done = [banded(x.q, x.t, *e, local, gap_open, gap_extend, wide) for x, e in zip(group, edges, strict=True)]
                out = []
                for x, (lower, right, best) in zip(group, done, strict=True):
                    row = of[id(x)]
                    below, last = row["r"] < row["rows"] - 1, row["c"] == row["columns"] - 1
                    # The lower edge is the upper one of the tile below, the right edge the left one of the tile beside.
                    if below:
                        out.append((row["pair"], "top", row["c"], *packed(lower), None))
                    if not last:
                        out.append((row["pair"], "left", row["r"], *packed(right), None))
                    if local or (last and not below):
                        out.append((row["pair"], "score", 0, None, None, None, int(best) if local else int(lower[0][-1])))
                kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(columns, kinds, strict=True)], ["pair", "kind", "at", "first", "h", "g", "score"])

    state = None
    for d, count in enumerate(counts):
        tiles = q_parts.withColumn("c", F.lit(d) - F.col("r")).where("c >= 0").join(t_parts, ["pair", "c"]).join(grid, "pair")
        if state is None:
            none = [F.lit(None).cast(t).alias(f"{kind}_{x}") for kind in ("top", "left") for x, t in (("first", "long"), ("h", "binary"), ("g", "binary"))]
            tiles = tiles.select("*", *none)
        else:
            of = lambda kind, at: state.where(F.col("kind") == kind).select("pair", F.col("at").alias(at), *(F.col(x).alias(f"{kind}_{x}") for x in ("first", "h", "g")))  # noqa: E731, B023
            tiles = tiles.join(of("top", "c"), ["pair", "c"], "left").join(of("left", "r"), ["pair", "r"], "left")
        # Round robin: each tile costs about the same, and a hash would give some tasks many and others none.
        new = tiles.repartition(min(count, -(-count // (TILES * cores)) * cores)).mapInArrow(solve, _EDGES)
        if state is not None:
            new = new.unionByName(state.where("kind = 'score'"))
        following = staged(new, "edges")
        if state is not None:
            drop(state)
        state = following
    if state is not None:
        scored = scored.unionByName(state.where("kind = 'score'").groupBy("pair").agg(F.max("score").alias("score")))
    aligned = first.join(scored, "pair").drop("pair")
    scores = staged(sized.select("pair", "texts", "m", "n").join(aligned, ["texts", "m", "n"]).select("pair", "score").unionByName(plain), "scores")
    for table in (state, q_parts, t_parts, sized):
        if table is not None:
            drop(table)
    return scores


def massive_search(targets: DataFrame, query: str, algorithm: str = "sw", threshold: int = 1 << 14, **options) -> DataFrame:
    """(target_id, len, score) of the targets (target_id, seq, len) of ``threshold`` residues and more, each over many tasks."""
    large = targets.where(F.col("len") >= threshold).withColumn("pair", F.monotonically_increasing_id())
    large = staged(large.select("pair", "target_id", "seq", "len"), "large")
    scores = massive_pairs(large.select("pair", F.lit(query).alias("query"), F.col("seq").alias("target")), algorithm, **options)
    return large.join(scores, "pair").select("target_id", "len", F.col("score").cast("int").alias("score"))
