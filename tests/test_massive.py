"""Massive pairs by tiles, and many queries against many targets."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomalign.functions.scoring import ALPHABET, encode
from loomalign.operators import kernels, many, tiled
from loomalign.operators.search import search


def _word(r, n, letters=ALPHABET[:20]):
    return "".join(r.choice(list(letters), n)) if n else ""


def _by_tiles(algorithm, q, t, side, wide, open_, extend):
    """Tile after tile in one process, as the rounds do it."""
    local, rows, columns = algorithm == "sw", -(-len(q) // side), -(-len(t) // side)
    tops, lefts, best = {}, {}, 0
    for r in range(rows):
        for c in range(columns):
            a, b = q[r * side : (r + 1) * side], t[c * side : (c + 1) * side]
            top = tops[c] if r else tiled.outer_edge(local, c * side, len(b), open_, extend)
            left = lefts[r] if c else tiled.outer_edge(local, r * side, len(a), open_, extend)
            tops[c], lefts[r], most = tiled.tile(a, b, top, left, local, open_, extend, wide)
            best = max(best, most)
    return best if local else int(tops[columns - 1][0][-1])


@pytest.mark.parametrize("algorithm", ["sw", "nw"])
def test_tiles_of_any_side(algorithm):
    r = np.random.default_rng(3)
    for k in range(300):
        m, n = r.integers(1, 50, 2)
        q, t = r.integers(0, 24, m).astype(np.uint8), r.integers(0, 24, n).astype(np.uint8)
        if k % 2:  # a good alignment, so that scores pass from tile to tile
            t = np.concatenate((q, t))[int(r.integers(0, 5)) :]
        open_ = int(r.integers(1, 12))
        extend = int(r.integers(0, open_ + 1))
        side = int(r.integers(1, 30))
        assert _by_tiles(algorithm, q, t, side, k % 3 == 0, open_, extend) == kernels.scalar(algorithm, q, t, open_, extend)


@pytest.mark.parametrize("algorithm", ["sw", "nw"])
def test_tiles_where_scores_leave_16_bits(algorithm):
    """Cells relative to a tile's corner: 16 bits hold them although scores pass 40,000."""
    r = np.random.default_rng(4)
    q = r.integers(0, 20, 9000).astype(np.uint8)
    t = np.concatenate((r.integers(0, 20, 700).astype(np.uint8), q))
    want = kernels.within(algorithm, q, t)
    assert want > 30_000
    assert _by_tiles(algorithm, q, t, 512, False, 10, 1) == want == _by_tiles(algorithm, q, t, 512, True, 10, 1)


@pytest.mark.parametrize("algorithm", ["sw", "nw"])
def test_tiles_far_below_zero(algorithm):
    """Corners below -32,768: a short sequence against a very long one, globally."""
    r = np.random.default_rng(14)
    q, t = r.integers(0, 20, 300).astype(np.uint8), r.integers(0, 20, 40_000).astype(np.uint8)
    want = kernels.within(algorithm, q, t)
    assert algorithm == "sw" or want < -36_000
    assert _by_tiles(algorithm, q, t, 256, False, 10, 1) == want
    assert _by_tiles(algorithm, t, q, 256, False, 10, 1) == want


def test_a_tile_has_bounded_memory():
    """A tile takes a few rows and the target's profile, not its cells."""
    q = np.random.default_rng(5).integers(0, 20, 2048).astype(np.uint8)
    tracemalloc.start()
    tiled.tile(q, q, tiled.outer_edge(True, 0, 2048), tiled.outer_edge(True, 0, 2048), True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2048 * 24 * 2 + 2048 * 8 * 24  # 0.5 MB, where the cells alone would be 8 MB


@pytest.mark.parametrize("algorithm", ["sw", "nw"])
def test_massive_pairs(spark, algorithm):
    """Pairs of many shapes in the same rounds; empty and null sides; bytes beyond ASCII."""
    r = np.random.default_rng(6)
    sizes = [(1, 1), (64, 64), (65, 63), (300, 10), (10, 300), (200, 201), (1, 400)]
    pairs = [(k, _word(r, m), _word(r, n)) for k, (m, n) in enumerate(sizes)]
    core = _word(r, 150)
    pairs += [(20, _word(r, 40) + core, core + _word(r, 90)), (21, "", "ARN"), (22, "ARN", ""), (23, "", ""), (24, None, "A"), (25, "A", None), (26, None, None), (27, "é" * 60 + core, core)]
    got = {x.pair: x.score for x in tiled.massive_pairs(spark.createDataFrame(pairs, "pair long, query string, target string"), algorithm, side=64).collect()}
    want = {k: None if q is None or t is None else int(kernels.scalar(algorithm, encode(q), encode(t))) for k, q, t in pairs}
    assert got == want


def test_massive_rounds_leave_nothing_to_repeat(spark):
    """What comes back is read from a table: no lineage of rounds; the tables of the rounds are gone."""
    from loomalign.sources import staged

    before = set(staged._KEPT)
    r = np.random.default_rng(7)
    pairs = spark.createDataFrame([(1, _word(r, 100), _word(r, 90))], "pair long, query string, target string")
    out = tiled.massive_pairs(pairs, "nw", side=32)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in plan and "MapInArrow" not in plan and "Join" not in plan
    assert len(set(staged._KEPT) - before) == 1
    assert tiled.massive_pairs(pairs.where("pair > 1"), "sw").collect() == []
    with pytest.raises(ValueError):
        tiled.massive_pairs(pairs, "sw", gap_open=1, gap_extend=2)


def test_massive_search(spark):
    r = np.random.default_rng(8)
    rows = [(i, _word(r, int(n))) for i, n in enumerate(r.integers(10, 300, 12))]
    targets = spark.createDataFrame(rows, "target_id long, seq string").withColumn("len", F.octet_length("seq"))
    query = _word(r, 170)
    got = {x.target_id: x.score for x in tiled.massive_search(targets, query, "sw", threshold=100, side=48).collect()}
    assert got == {i: int(kernels.within("sw", encode(query), encode(s))) for i, s in rows if len(s) >= 100}


@pytest.fixture(scope="module")
def some(spark):
    r = np.random.default_rng(9)
    rows = [(i, _word(r, int(n))) for i, n in enumerate(r.integers(0, 60, 40))] + [(100, None), (101, ""), (102, "é*x"), (7, "ARNDC")]
    return rows, spark.createDataFrame(rows, "target_id long, seq string")


@pytest.mark.parametrize("algorithm", ["sw", "nw"])
def test_queries_as_a_table(spark, some, algorithm):
    """Blocks so small that there are many; nulls on both sides; the same scores as queries sent with the tasks."""
    rows, targets = some
    asked = [("a", "HEAGAWGHEE"), ("b", "PAWHEAE*XZB"), ("c", ""), ("d", None), ("e", _word(np.random.default_rng(1), 50))]
    queries = spark.createDataFrame(asked, "query_id string, seq string")
    for sizes in ({}, {"query_residues": 20, "target_residues": 100}):
        got = sorted((x.query_id, x.target_id, x.len, x.score) for x in many.search_many(targets, queries, algorithm, **sizes).collect() if x.score is not None)
        want = sorted((n, i, len(s.encode()), int(kernels.scalar(algorithm, encode(q), encode(s)))) for n, q in asked if q is not None for i, s in rows if s is not None)
        assert got == want
    whole = many.search_many(targets, queries, algorithm)
    assert whole.count() == len(rows) * len(asked)
    twice = search(targets.withColumn("len", F.octet_length("seq")), queries, algorithm)
    assert sorted(map(repr, twice.select("query_id", "target_id", "score").collect())) == sorted(map(repr, whole.select("query_id", "target_id", "score").collect()))


def test_long_query_fails(spark, some):
    queries = spark.createDataFrame([("q", "A" * 51)], "query_id string, seq string")
    with pytest.raises(Exception, match="the limit is 50"):
        many.search_many(some[1], queries, max_query=50).collect()


@pytest.mark.parametrize("algorithm", ["sw", "nw"])
def test_all_pairs(spark, some, algorithm):
    rows, targets = some
    want = sorted((i, j, None if a is None or b is None else int(kernels.scalar(algorithm, encode(a), encode(b)))) for i, a in rows for j, b in rows) if algorithm == "sw" else None
    for residues in (1 << 18, 150):
        got = sorted(((x.a, x.b, x.score) for x in many.all_pairs(targets, algorithm, residues=residues).collect()), key=repr)
        if want is not None:
            assert got == sorted(want, key=repr)
        assert len(got) == len(rows) ** 2


def test_each_pair_is_scored_once(spark, some, monkeypatch):
    """Calls of the kernel in one process: half of the pairs, by symmetry."""
    calls = []
    real = kernels.scores
    monkeypatch.setattr(kernels, "scores", lambda a, q, seqs, *x: calls.append(len(seqs)) or real(a, q, seqs, *x))
    rows = [encode(s) for _, s in some[0] if s is not None]
    for k in range(len(rows)):
        many._score("sw", rows[k], rows[k:], 4096, 10, 1)
    assert sum(calls) == len(rows) * (len(rows) + 1) // 2


def test_no_side_passes_through_the_driver(spark, some):
    plan = many.all_pairs(some[1], residues=150)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "LocalLimit" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
