"""Bounded top-k, seeds, E-values, functions for SQL, samples: each against the whole search or brute force."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomalign.functions import callable as functions
from loomalign.functions.scoring import ALPHABET, MATRIX, encode
from loomalign.operators import bounded, kernels, seeding, statistics
from loomalign.operators import layout as L
from loomalign.operators.search import search, top_hits


def _word(r, n):
    return "".join(r.choice(list(ALPHABET[:20]), n)) if n else ""


def _frame(spark, rows):
    return spark.createDataFrame(rows, "target_id long, seq string").withColumn("len", F.octet_length("seq"))


@pytest.fixture(scope="module")
def database(spark):
    """Random sequences, some that hold a mutated piece of the queries, equal ones, an empty and a null one."""
    r = np.random.default_rng(21)
    queries = {"a": _word(r, 60), "b": _word(r, 90)}
    rows = [(i, _word(r, int(n))) for i, n in enumerate(r.integers(5, 200, 300))]
    for i in range(300, 330):
        q = queries["ab"[i % 2]]
        a = int(r.integers(0, 20))
        piece = list(q[a : a + 40])
        for k in r.integers(0, 40, 6):
            piece[k] = str(r.choice(list(ALPHABET[:20])))
        rows.append((i, _word(r, 30) + "".join(piece) + _word(r, 30)))
    rows += [(400 + i, rows[305][1]) for i in range(8)] + [(500, ""), (501, None), (502, "é~ *"), (600, queries["a"]), (601, queries["b"])]
    return queries, rows, _frame(spark, rows)


# ---- bounded top-k -------------------------------------------------------------------


@pytest.mark.parametrize("algorithm", ["sw", "nw"])
def test_bounds_hold(algorithm):
    r = np.random.default_rng(22)
    for _ in range(150):
        q = r.integers(0, 24, int(r.integers(0, 30))).astype(np.uint8)
        seqs = [r.integers(0, int(r.integers(1, 25)), int(r.integers(0, 40))).astype(np.uint8) for _ in range(8)]
        limit = bounded.bounds(algorithm, q, bounded._counts(seqs))
        assert all(kernels.scalar(algorithm, q, t) <= b for t, b in zip(seqs, limit.tolist(), strict=True))
    # A sequence with itself reaches its bound.
    q = np.arange(20, dtype=np.uint8)
    assert bounded.bounds(algorithm, q, bounded._counts([q]))[0] == kernels.scalar(algorithm, q, q)


@pytest.mark.parametrize("algorithm", ["sw", "nw"])
@pytest.mark.parametrize("k", [1, 7, 1000])
def test_bounded_equals_whole_search(database, algorithm, k, monkeypatch):
    """The same hits, ranks and ties; less work where k is small."""
    monkeypatch.setattr(bounded, "SLICE", 16)
    queries, rows, targets = database
    hits, work = bounded.bounded_top_hits(targets, queries, k, algorithm, sample=50)
    want = top_hits(search(targets, queries, algorithm), k)
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, want.collect()))
    for w in work.collect():
        assert w.targets == len(rows) - 1 and w.cells == len(queries[w.query_id]) * sum(len(s.encode()) for _, s in rows if s)
        assert w.scored <= w.targets and w.scored_cells <= w.cells
    if k == 1:  # a good threshold from the start: targets too short, or too unlike, are never scored
        shares = [w.scored_cells / w.cells for w in bounded.bounded_top_hits(targets, queries, k, algorithm, sample=1000)[1].collect()]
        assert max(shares) < (0.9 if algorithm == "sw" else 0.3), shares
    if k == 1000:
        assert all(w.scored == w.targets for w in work.collect())


# ---- seeds -----------------------------------------------------------------------------


def test_neighbourhood():
    q = encode("ARNDW*")
    word, at = seeding.neighbourhood(q, 3, 11)
    want = {(a * 576 + b * 24 + c, i) for i in range(4) for a in range(23) for b in range(23) for c in range(23) if sum(int(MATRIX[x, y]) for x, y in zip(q[i : i + 3], (a, b, c), strict=True)) >= 11}
    assert set(zip(word.tolist(), at.tolist(), strict=True)) == want and len(word) == len(want)
    word, at = seeding.words(encode("AR~NDC"), 3)
    assert (word.tolist(), at.tolist()) == ([2 * 576 + 3 * 24 + 4], [3])


def test_candidates_are_two_seeds_on_a_diagonal(spark, database):
    queries, rows, targets = database
    table = spark.createDataFrame(list(queries.items()), "query_id string, seq string")
    asked = seeding.query_words(table)
    want = set()
    for name, q in queries.items():
        near = {}
        for w, p in zip(*(x.tolist() for x in seeding.neighbourhood(encode(q), 3, 11)), strict=True):
            near.setdefault(w, []).append(p)
        for i, s in rows:
            diagonals = {}
            for w, p in zip(*(x.tolist() for x in seeding.words(encode(s or ""), 3)), strict=True):
                for at in near.get(w, ()):
                    diagonals.setdefault(p - at, []).append(p)
            if any(3 <= y - x <= 40 for ps in diagonals.values() for x in ps for y in ps):
                want.add((name, i))
    for small in (seeding.SMALL, 0):  # broadcast, or dealt by salted words
        got = seeding.candidates(seeding.word_rows(targets), asked, small=small).collect()
        assert len(got) == len(want) and {tuple(x) for x in got} == want
    assert 0 < len(want) < 2 * len(rows)


def test_seeded_search(spark, database, tmp_path):
    """Scores are those of the whole search; nearly all of its best hits are found; the index is read by words."""
    queries, rows, targets = database
    table = spark.createDataFrame(list(queries.items()), "query_id string, seq string")
    seeding.write_index(targets, str(tmp_path / "index"))
    index = seeding.read_index(spark, str(tmp_path / "index"))
    found = seeding.seeded_search(targets, table, index)
    exact = search(targets, queries, "sw")
    scores = {(x.query_id, x.target_id): x.score for x in exact.collect()}
    got = {(x.query_id, x.target_id): x.score for x in found.collect()}
    assert got and all(scores[key] == v for key, v in got.items())
    assert seeding.recall(found, exact, 10) >= 0.9
    some = index.where(F.col("word").isin(5, 7))
    assert "PushedFilters: [In(word" in some._jdf.queryExecution().executedPlan().toString()
    assert seeding.seeded_search(targets.where("target_id < 0"), table).collect() == []


@pytest.mark.parametrize("held", [1, 40, 1 << 20])
def test_lookup_is_the_join_of_words(monkeypatch, held):
    """Pairs with two seeds on a diagonal in one text, whatever number of seeds is taken at a time; texts do not meet."""
    monkeypatch.setattr(seeding, "_HELD", held)
    r = np.random.default_rng(5)
    queries = {f"q{i}": r.integers(0, 4, n).astype(np.uint8) for i, n in enumerate((30, 3, 0, 60, 12))}
    texts = [r.integers(0, int(r.choice([3, 5, 24])), int(n)).astype(np.uint8) for n in (0, 2, 5, 40, 200, 90, 3, 4, 61)]
    texts += [queries["q3"][:4], queries["q3"][6:10], np.zeros(300, np.uint8)]
    rows = [(w, name, p) for name, q in queries.items() for w, p in zip(*(x.tolist() for x in seeding.neighbourhood(q, 3, 14)), strict=True)]
    asked = pa.table({"word": pa.array([x[0] for x in rows], pa.int64()), "query_id": [x[1] for x in rows], "q_pos": pa.array([x[2] for x in rows], pa.int32())})
    want = set()
    for i, t in enumerate(texts):
        diagonals = {}
        for w, at in zip(*(x.tolist() for x in seeding.words(t, 3)), strict=True):
            for word, name, p in rows:
                if word == w:
                    diagonals.setdefault((name, at - p), set()).add(at)
        want |= {(i, name) for (name, _), ats in diagonals.items() if any(3 <= y - x <= 20 for x in ats for y in ats)}
    lookup = seeding._Lookup(asked, 3, 20)
    got = [(i, lookup.names[q]) for i, q in lookup.pairs(texts)]
    assert len(got) == len(set(got)) and set(got) == want and 3 < len(want) < len(texts) * len(queries)
    assert lookup.pairs([]) == [] and seeding._Lookup(asked.slice(0, 0), 3, 20).pairs(texts) == []


@pytest.mark.parametrize("algorithm", ["sw", "nw"])
def test_search_without_an_index(spark, database, algorithm):
    """The same rows as by the index; no word or seed is shuffled, and scores are dealt by an explicit number of tasks."""
    queries, rows, targets = database
    table = spark.createDataFrame(list(queries.items()), "query_id string, seq string")
    found = seeding.seeded_search(targets, table, algorithm=algorithm)
    got = sorted(map(tuple, found.collect()))
    want = sorted(map(tuple, seeding.seeded_search(targets, table, seeding.word_rows(targets), algorithm).collect()))
    assert len(got) > 3 and got == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "word#" not in plan and "REPARTITION_BY_NUM" in plan


@pytest.mark.parametrize("costs", [(10, 1), (3, 0), (5, 2), (1, 1)])
def test_pairs_beside_each_other(monkeypatch, costs):
    """Each pair has the definition's score, with gaps longer than what lies between two targets."""
    monkeypatch.setattr(kernels, "BESIDE_CELLS", 2000)
    r = np.random.default_rng(7)
    word = lambda n: r.integers(0, int(r.choice([2, 5, 24])), n).astype(np.uint8)
    queries, targets = [], []
    for k in range(40):
        q = word(int(r.integers(0, 50)))
        far = np.full(int(r.integers(0, 150)), 23, np.uint8)
        queries.append(q)
        targets.append(word(int(r.integers(0, 90))) if k % 2 else np.concatenate((word(9), q[: len(q) // 2], far, q[len(q) // 2 :])))
    got = kernels.beside(queries, targets, *costs).tolist()
    assert got == [kernels.scalar("sw", q, t, *costs) for q, t in zip(queries, targets, strict=True)]
    # Scores beyond 16 bits.
    w = np.full(2000, 17, np.uint8)
    assert kernels.beside([w, w[:5]], [w, w]).tolist() == [22000, 55] and kernels.beside([], []).tolist() == []


# ---- E-values ------------------------------------------------------------------------


def test_evalues_of_shuffled_sequences(spark):
    """Chance scores: as many E-values below a limit as the limit says; a planted relative stands out."""
    r = np.random.default_rng(23)
    q = _word(r, 120)
    base = list(_word(r, 4000))
    rows = []
    for i in range(2000):
        r.shuffle(base)
        rows.append((i, "".join(base[: int(r.integers(40, 400))])))
    rows += [(9001, q[20:100]), (9002, _word(r, 50) + q[:60]), (9003, None), (9004, "")]
    scores = search(_frame(spark, rows), {"q": q}, "sw").select("query_id", "target_id", "len", "score")
    got = {x.target_id: x for x in statistics.evalues(scores, {"q": len(q)}).collect()}
    e = np.array([got[i].evalue for i in range(2000)])
    for limit in (20, 200, 1000):
        assert 0.7 * limit < (e <= limit).sum() < 1.35 * limit
    assert got[9001].evalue < 1e-6 and got[9002].evalue < 1e-6 and got[9001].bits > 40
    assert got[9003].evalue is None and got[9003].bits is None and len(got) == len(rows)
    # The fit does not move with the relatives.
    fit = statistics.fit(scores).first()
    x = np.log([len(s) for _, s in rows[:2000]])
    y = np.array([got[i].score for i in range(2000)], float)
    slope, place = np.polyfit(x, y, 1)
    assert abs(fit.slope - slope) < 0.1 * abs(slope) and abs(fit.spread - np.std(y - place - slope * x)) < 0.1 * fit.spread


def test_evalues_where_nothing_varies(spark):
    rows = spark.createDataFrame([("q", i, 10, 30) for i in range(5)], "query_id string, target_id long, len int, score int")
    got = statistics.evalues(rows).collect()
    assert all(x.z == 0 and math.isclose(x.evalue, 5 * (1 - math.exp(-math.exp(-statistics.EULER)))) for x in got)
    assert statistics.evalues(rows.where("len > 10")).collect() == []


# ---- functions for SQL ------------------------------------------------------------------


def test_functions(spark, database):
    queries, rows, targets = database
    functions.register(spark)
    for algorithm in ("sw", "nw"):
        got = spark.sql("SELECT target_id, align_score(:q, seq, :a) AS score FROM {t}", args={"q": queries["a"], "a": algorithm}, t=targets).collect()
        want = {x.target_id: x.score for x in search(targets, queries["a"], algorithm).collect()}
        assert {x.target_id: x.score for x in got} == want
    both = spark.sql("SELECT p.*, s.score FROM (SELECT target_id, align_score('ARND', seq, 'sw') AS score, seq FROM {t} WHERE target_id < 20 OR target_id > 498) s, LATERAL align_path('ARND', s.seq, 'sw') p", t=targets).collect()
    assert len(both) == 24 and all(x.path_score == x.score for x in both)
    assert spark.sql("SELECT align_score(NULL, 'A', 'sw') AS a, align_score('A', NULL, 'sw') AS b, align_score('A', 'A', NULL) AS c").first().asDict() == {"a": None, "b": None, "c": None}
    with pytest.raises(Exception, match="algorithm is"):
        spark.sql("SELECT align_score('A', 'A', 'xx')").collect()


# ---- samples ------------------------------------------------------------------------------


def test_large_samples_are_not_gathered(spark):
    """A third of a table, exactly, equal to the top-n by hash; no stage takes it into one partition."""
    import hashlib

    df = spark.range(3000).select(F.col("id").alias("target_id"), F.lit(1).alias("len")).repartition(5)
    order = sorted(range(3000), key=lambda i: (hashlib.md5(f"7:{i}".encode()).hexdigest(), i))
    for n in (1000, 1, 2999, 3000, 5000):
        got = L.md5_sample(df, n, 7, gather=20)
        assert sorted(x.target_id for x in got.collect()) == sorted(order[:n])
    plan = L.md5_sample(df, 1000, 7, gather=20)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=1000" not in plan
    # Equal keys: only their number can decide.
    same = spark.range(100).select(F.lit(5).cast("long").alias("target_id"), F.lit(1).alias("len"))
    assert L.md5_sample(same, 33, 7, gather=20).count() == 33
    nulls = spark.createDataFrame([(None, 1), (1, 1), (2, 1)], "target_id long, len int")
    assert L.md5_sample(nulls, 2, 7, gather=1).count() == 2
