"""Nearest neighbours, whitening and periodic runs against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loomalign.llm import common as C
from loomalign.llm import cross_polytope, embedding_dedup, packing, periodic_runs, whitening

W = re.compile(r"[^\x20\x09-\x0D]+")


def _table(spark, rows, kind="float", name="embedding"):
    return spark.createDataFrame(rows, f"vec_id long, {name} array<{kind}>, extra string")


# ---- periodic runs ---------------------------------------------------------------


def _runs(s):
    """Every period by itself, smallest first."""
    s, out = np.array(s), {}
    for p in range(1, len(s) // 4 + 1):
        same = np.concatenate(([False], s[:-p] == s[p:], [False])).astype(np.int8)
        for i, j in zip(np.flatnonzero(np.diff(same) == 1).tolist(), np.flatnonzero(np.diff(same) == -1).tolist(), strict=True):
            if j - i + p >= max(6, 4 * p):
                out.setdefault((i, j - i + p), p)
    return sorted((a, n, p) for (a, n), p in out.items())


def _strings(r):
    for k in range(1500):
        n = int(r.integers(1, 90))
        if k % 4 == 0:
            yield r.integers(0, 2, n)
        elif k % 4 == 1:
            yield r.integers(0, r.integers(1, 4), n)
        elif k % 4 == 2:
            p = int(r.integers(1, 14))
            s = np.tile(r.integers(0, 5, p), n // p + 1)[:n]
            s[r.integers(0, n, r.integers(0, 3))] = 9
            yield s
        else:
            yield np.concatenate([np.tile(r.integers(0, 3, r.integers(1, 6)), r.integers(1, 8)) for _ in range(r.integers(1, 6))])


def test_runs_of_strings():
    for s in _strings(np.random.default_rng(2)):
        assert periodic_runs.runs(s.astype(np.int64)) == _runs(s), s.tolist()


def test_runs_of_batches_of_texts():
    """Texts of a batch are masked and halved together and do not touch each other."""
    r = np.random.default_rng(4)
    strings = list(_strings(r))
    for k in range(0, len(strings), 7):
        texts = [np.zeros(0, np.int64), *strings[k : k + 7]]
        first = np.concatenate(([0], np.cumsum(list(map(len, texts)))))
        words = C.mixed(np.concatenate(texts).astype(np.uint64) + np.uint64(3))
        assert periodic_runs.text_runs(words, first) == [_runs(t) if len(t) else [] for t in texts]


def test_masking_keeps_every_run():
    """k comes from the least overlap: 5 words for runs of six words and four periods."""
    assert periodic_runs.overlap() == 5
    s = np.array([1, 2, 3, 7, 7, 7, 7, 7, 7, 4, 5, 6], np.uint64)
    assert periodic_runs.survivors(C.mixed(s), np.array([0, 12]), 5).tolist() == [3 <= i < 9 for i in range(12)]


def _expected(doc_id, text, plant):
    w = W.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    number = {}
    found = _runs([number.setdefault(x, len(number)) for x in w]) if w else []
    gone = {i for a, length, p in found for i in range(a + p, a + length)}
    top = max(found, key=lambda x: (x[1], -x[0], -x[2])) if found else None
    best = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *best, sha("".join(f"{a},{n},{p}\n" for a, n, p in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_op13(spark, corpus, docs):
    short = docs[[t is None or len(t) < 100_000 for t in docs.text]]
    want = {d: _expected(d, t, True) for d, t in zip(short.doc_id.tolist(), short.text, strict=True)}
    got = {r.doc_id: tuple(r) for r in periodic_runs.op13(spark, corpus).collect()}
    assert len(got) == len(docs) and sum(v[1] > 0 for v in want.values()) > 5
    assert {d: got[d] for d in want} == want


def test_op13_odd_rows(spark):
    """Null, empty and wordless texts, repeated rows, no id, words that only differ in bytes beyond ASCII, one run that is the whole text."""
    texts = [(7, None), (7, ""), (8, " \n\t"), (None, "x y " * 40), (None, "x y " * 40), (9, "é è " * 9), (10, "é  " * 7), (11, "w " * 200_001)]
    got = periodic_runs.digests(periodic_runs.found_runs(spark.createDataFrame(texts, "doc_id long, text string").withColumn("runs", F.lit(1)))).collect()
    want = [_expected(d, t, False) if d != 11 else (11, 1, 0, 200_001, 1, 200_001_000, hashlib.sha256(b"0,200001,1\n").hexdigest(), hashlib.sha256(b"w").hexdigest()) for d, t in texts]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


# ---- whitening --------------------------------------------------------------------


def test_jacobi():
    r = np.random.default_rng(3)
    for d in (1, 2, 3, 5, 16, 33):
        b = r.normal(size=(d, d))
        m = b @ b.T
        values, axes = whitening.jacobi(m)
        assert np.allclose(axes @ np.diag(values) @ axes.T, m, atol=1e-12 * d) and np.allclose(axes.T @ axes, np.eye(d), atol=1e-13)
        assert (np.diff(values) <= 0).all() and np.allclose(values, np.linalg.eigvalsh(m)[::-1], rtol=1e-9)
    assert whitening.jacobi(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]


def test_jacobi_small_eigenvalues():
    """Scaled diagonally dominant: small eigenvalues keep their relative accuracy."""
    s = np.logspace(0, -9, 10)
    m = (np.eye(10) + 0.01 * np.ones((10, 10))) * np.outer(s, s)
    from fractions import Fraction

    values = whitening.jacobi(m)[0]
    # The product of all eigenvalues, exactly, by elimination over fractions.
    rows, det = [[Fraction(float(x)) for x in row] for row in m], Fraction(1)
    for i in range(10):
        det *= rows[i][i]
        for j in range(i + 1, 10):
            f = rows[j][i] / rows[i][i]
            rows[j] = [a - f * b for a, b in zip(rows[j], rows[i], strict=True)]
    assert abs(float(np.prod(values)) / float(det) - 1) < 1e-10


def _check_whitened(got, x, ids, components=8):
    """Against the eigenvectors of the whole matrix, up to signs."""
    n = len(x)
    whole = np.floor(x * 1024) + 100_000
    centred = whole - whole.mean(0)
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, x.shape[1])
    want = centred @ axes[:, :k] / np.sqrt(values[:k])
    exact = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, whole.sum(0), strict=True)) for row in whole]
    by = {(r.vec_id, r.component): r for r in got}
    assert len(got) == n * k and all(r.n == n for r in got)
    w = np.array([[by[i, c + 1].whitened for c in range(k)] for i in ids])
    signs = np.sign((w * want).sum(0))
    assert np.allclose(w, want * signs, atol=1e-9)
    assert [by[i, 1].deviation for i in ids] == exact
    assert np.allclose([by[ids[0], c + 1].explained for c in range(k)], values[:k] / np.trace(cov), rtol=1e-9)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9
    assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-9


def test_op12(spark, corpus):
    e = pq.read_table(f"{corpus}/embeddings.parquet").to_pylist()
    good = [(r["vec_id"], r["embedding"]) for r in e if r["embedding"] and all(v is not None and np.isfinite(v) for v in r["embedding"])]
    got = whitening.op12(spark, corpus).collect()
    long = [(i, v) for i, v in good if len(v) == 16]
    # The one vector of eight entries is a list of its own, in which nothing varies.
    other = [r for r in got if r.n == 1]
    assert len(other) == 8 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in other)
    _check_whitened([r for r in got if r.n > 1], np.array([v for _, v in long], float), [i for i, _ in long])


def test_whitening_odd_vectors(spark):
    """Few dimensions, a constant one, repeated rows, no id, nulls, other lengths, huge entries."""
    r = np.random.default_rng(8)
    x = np.c_[r.normal(size=(40, 2)), np.full(40, 3.0)]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(None, x[0].tolist(), "x"), (0, x[0].tolist(), "x"), (90, None, "x"), (91, [], "x"), (92, [1.0, None, 2.0], "x"), (93, [float("nan")] * 3, "x"), (94, [float("inf")] * 3, "x")]
    got = whitening.whitened(_table(spark, rows, "double").withColumnRenamed("extra", "dim")).collect()
    assert len(got) == 42 * 3 and {g.n for g in got} == {42}
    assert all((g.whitened is None) == (g.component == 3) for g in got) and all(g.identity_error < 1e-10 for g in got)
    assert all(abs(g.explained) < 1e-12 for g in got if g.component == 3)
    assert len([g for g in got if g.vec_id == 0]) == 6 and len([g for g in got if g.vec_id is None]) == 3
    huge = [(i, [1e300 * (i % 2), float(i)], "x") for i in range(6)]
    got = whitening.whitened(_table(spark, huge, "double")).collect()
    assert len(got) == 12 and all(g.deviation is None for g in got) and got[0].identity_error < 1e-6
    assert whitening.whitened(_table(spark, [], "double")).collect() == []


def test_whitening_does_not_depend_on_partitions(spark, corpus):
    e = spark.read.parquet(f"{corpus}/embeddings.parquet").select("vec_id", "embedding")
    one = {(r.vec_id, r.component): tuple(r)[:6] for r in whitening.whitened(e.coalesce(1)).collect()}
    many = {(r.vec_id, r.component): tuple(r)[:6] for r in whitening.whitened(e.repartition(7)).collect()}
    assert one == many


def test_exact_products():
    z = np.array([[3, -(1 << 40)], [5, 1 << 41]], np.int64)
    assert whitening.products(z).tolist() == [[34, 7 * (1 << 40)], [7 * (1 << 40), (1 << 80) + (1 << 82)]]


# ---- nearest neighbours -----------------------------------------------------------


def _near(rows, k=10, asks=lambda i: i % 100 == 0):
    """Every row of a query against all other rows; rows are (id, vector)."""
    out = []
    for a, (i, v) in enumerate(rows):
        if not asks(i):
            continue
        all_ = [(float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j) for b, (j, w) in enumerate(rows) if b != a and len(w) == len(v)]
        out.append((i, sorted(all_)[:k]))
    return out


def _answers(df):
    got = {}
    for r in df.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    return {i: sorted(v) for i, v in got.items()}


def _usable(table):
    return [(r["vec_id"], np.array(r["embedding"], float)) for r in table.to_pylist() if r["embedding"] and all(v is not None and np.isfinite(v) for v in r["embedding"]) and any(r["embedding"])]


def test_hadamard():
    x = np.random.default_rng(0).normal(size=(3, 8))
    h = np.array([[1.0]])
    for _ in range(3):
        h = np.block([[h, h], [h, -h]])
    assert np.allclose(cross_polytope.hadamard(x), x @ h / np.sqrt(8))
    y = cross_polytope.rotated(x[:, :5], 1, 0)
    assert y.shape == (3, 8) and np.allclose((y * y).sum(1), (x[:, :5] ** 2).sum(1))


@pytest.mark.parametrize("bits", [0, 1, 4, 5, 9])
def test_probes(bits):
    """The first probe is the own bucket; probes are the best sums over all functions, each bucket once."""
    x = cross_polytope.unit(np.random.default_rng(1).normal(size=(20, 16)))
    own = cross_polytope.buckets(x, 0, bits)
    codes = cross_polytope.probes(x, 0, bits, 40)
    assert (codes[:, 0] == own).all() and codes.shape[1] == min(40, 1 << bits) and own.max() < 1 << bits
    sides = list(cross_polytope._sides(x, 0, bits))
    for row in range(len(x)):
        scores = {0: 0.0}
        for side in sides:
            scores = {c * side.shape[1] + j: s + side[row, j] for c, s in scores.items() for j in range(side.shape[1])}
        best = sorted(scores.values(), reverse=True)[: codes.shape[1]]
        assert [scores[c] for c in codes[row].tolist()] == best and len(set(codes[row].tolist())) == len(best)


def test_op11(spark, corpus):
    want = _near(_usable(pq.read_table(f"{corpus}/embeddings.parquet")))
    got = _answers(cross_polytope.op11(spark, corpus))
    # 300 vectors are one bucket: the search is exact.
    assert {i: [(k + 1, *x) for k, x in enumerate(v)] for i, v in want} == got


@pytest.mark.parametrize("tile", [7, 8192])
def test_recall_and_exact_scores(spark, monkeypatch, tile):
    """Many small buckets and tiles: the share promised is found, and what is found has its exact distance and order."""
    monkeypatch.setattr(cross_polytope, "TILE_ROWS", tile)
    monkeypatch.setattr(cross_polytope, "TILE_QUERIES", tile)
    r = np.random.default_rng(5)
    centres = r.normal(size=(40, 24))
    x = (centres[r.integers(0, 40, 1500)] + 0.4 * r.normal(size=(1500, 24))) * r.uniform(0.5, 2, (1500, 1))
    x[1200:] = x[3] + 1e-3 * r.normal(size=(300, 24))  # a fifth of all rows is one bucket
    rows = [(int(i), v) for i, v in enumerate(x.astype(np.float32).astype(float))]
    df = _table(spark, [(i, v.tolist(), "x") for i, v in rows])
    known, _ = cross_polytope._distinct(df, 10, F.col("vec_id") % 20 == 0)
    chosen = cross_polytope.settings(known, bucket=16)
    assert chosen[24][0] >= 3 and chosen[24][2] >= 0.95
    got = _answers(cross_polytope.search(df, F.col("vec_id") % 20 == 0, chosen=chosen))
    want = _near(rows, asks=lambda i: i % 20 == 0)
    place, hits = dict(rows), 0
    assert len(got) == len(want)
    for i, best in want:
        assert [k for k, _, _ in got[i]] == list(range(1, 11))
        assert all(d == float(np.sqrt(((place[i] - place[j]) ** 2).sum())) for _, d, j in got[i])
        hits += len({j for _, j in best} & {j for _, _, j in got[i]})
    assert hits >= 0.93 * 10 * len(want)


def test_copies_ties_and_few_candidates(spark):
    """Groups of copies, repeated ids, ties, other lengths, queries whose buckets are empty."""
    v, w = [1.0, 2.0, 3.0], [1.0, 2.0, 4.0]
    rows = [(100 * i, v) for i in range(15)] + [(7, v), (7, v), (100, w), (300, w), (3, [5.0, 5.0, 5.0]), (5, [-1.0, 0.0, 0.0]), (200, [1.0, 0.0]), (400, [0.0, -0.0, 1.0]), (401, [0.0, 0.0, 1.0]), (500, [1.0] * 7)]
    odd = [(600, None), (700, []), (800, [0.0] * 3), (900, [None, 1.0, 1.0]), (1000, [float("nan"), 0.0, 1.0]), (None, v)]
    df = _table(spark, [(i, x, "x") for i, x in rows + odd]).withColumnRenamed("extra", "rid")
    want = _near([(i, np.array(x)) for i, x in rows])
    for chosen in (None, {2: (0, 1, 1.0), 3: (3, 1, 0.5), 7: (2, 1, 1.0)}):
        got = cross_polytope.search(df, F.col("vec_id") % 100 == 0, chosen=chosen).collect()
        flat = sorted((r.query_id, r["rank"], r.score, r.vec_id) for r in got)
        if chosen is None:
            assert flat == sorted((i, k + 1, *x) for i, best in want for k, x in enumerate(best))
        # However few buckets are probed, every query gets as many as there are.
        assert len(flat) == sum(len(best) for _, best in want)


def test_hot_bucket_is_split(spark):
    """Queries and rows of one bucket are dealt over tiles; the answer is that of brute force."""
    x = np.random.default_rng(9).normal(size=(600, 8))
    rows = [(i, v) for i, v in enumerate(x)]
    df = _table(spark, [(i, v.tolist(), "x") for i, v in rows], "double")
    old = cross_polytope.TILE_ROWS, cross_polytope.TILE_QUERIES
    cross_polytope.TILE_ROWS, cross_polytope.TILE_QUERIES = 50, 30
    try:
        got = _answers(cross_polytope.search(df, F.col("vec_id") % 2 == 0, chosen={8: (0, 1, 1.0)}))
    finally:
        cross_polytope.TILE_ROWS, cross_polytope.TILE_QUERIES = old
    assert got == {i: [(k + 1, *x) for k, x in enumerate(best)] for i, best in _near(rows, asks=lambda i: i % 2 == 0)}


def test_nearest_allows_for_rounding():
    """Far from the origin products lose digits; the distances and their order do not."""
    r = np.random.default_rng(1)
    x = 1e6 + r.normal(size=(400, 6)) * 1e-3
    d = np.array([[np.sqrt(((a - b) ** 2).sum()) for b in x] for a in x[:5]])
    q, v, dist = cross_polytope.nearest(x[:5], np.arange(5), x, np.arange(400), np.arange(400), 10)
    for i in range(5):
        order = [j for j in np.lexsort((np.arange(400), d[i])) if j != i][:10]
        assert v[q == i].tolist() == order and dist[q == i].tolist() == d[i][order].tolist()


# ---- near-duplicate vectors that share an id -----------------------------------------


@pytest.mark.parametrize("tile", [2, 2048])
def test_op9_equal_ids(spark, tile):
    """Different vectors of one id are nodes of their own: links and components are those of brute force over rows."""
    r = np.random.default_rng(6)
    centres = r.normal(size=(6, 5))
    rows = [(int(r.integers(0, 9)), (centres[k % 6] + 0.15 * r.normal(size=5)).tolist(), int(k % 2)) for k in range(40)]
    rows += [(1, [1.0, 0.0, 0.0], 0), (1, [0.0, 1.0, 0.0], 0), (2, [1.0, 0.01, 0.0], 0), (3, [0.01, 1.0, 0.0], 0), (3, [0.01, 1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    near = [[a != b and x[2] == y[2] and len(x[1]) == len(y[1]) and np.dot(x[1], y[1]) / np.linalg.norm(x[1]) / np.linalg.norm(y[1]) >= 0.93 for b, y in enumerate(rows)] for a, x in enumerate(rows)]
    want = []
    for a, (i, _, _) in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            x = todo.pop()
            more = {b for b in range(len(rows)) if near[x][b]} - seen
            seen |= more
            todo += more
        name = min(rows[b][0] for b in seen)
        want.append((i, sum(near[a]), name, name == i))
    got = embedding_dedup.near_duplicates(df, tile=tile).collect()
    assert sorted(map(tuple, got)) == sorted(want)


# ---- packing of rows that share an id ---------------------------------------------------


@pytest.mark.parametrize("doc_id", [None, 7])
def test_packing_deals_rows_without_ids_of_their_own(spark, doc_id):
    """100,000 pieces of no (or one) doc_id are many shards, and packed as tightly as others."""
    n, shard = 100_000, 5000
    length = (F.col("id") * 7919 % 900 + 1).cast("long")
    parts = spark.range(n).select(F.lit(doc_id).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), length.alias("length"), F.crc32(F.col("id").cast("string")).alias("ids_crc32"))
    got = packing.packed(parts, shard_pieces=shard)
    per = got.groupBy(F.shiftright("sequence_id", 32).alias("shard")).count().collect()
    assert len(per) == n // shard and max(r["count"] for r in per) < 1.2 * shard
    ends = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.min("offset").alias("first"), F.countDistinct("offset").alias("places"), F.count("*").alias("rows"))
    assert ends.where("n > 2048 or n <> end or first <> 0 or places <> rows").isEmpty()
    tokens = got.agg(F.sum("length").alias("n")).first().n
    assert got.count() == n and ends.count() <= 1.01 * -(-tokens // 2048)
