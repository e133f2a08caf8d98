import numpy as np
import pytest
from pyspark.sql import functions as F

from loomalign.functions.scoring import BLOSUM62, MATRIX, encode, encode_column, read_matrix
from loomalign.operators import kernels
from loomalign.operators import kernels as K
from loomalign.operators import layout as L
from loomalign.operators import verify as V
from loomalign.operators.search import narrow_first, search, top_hits

SEQS = ["ARNDCQ", "", "MKVLMKVLMKVLAW", "HEAGAWGHEE", "PAWHEAE", "W", "A" * 50, "jou*?", "HEAGAWGHEE"]


@pytest.fixture(scope="module")
def targets(spark):
    rows = [(i, s, len(s)) for i, s in enumerate(SEQS)] + [(99, None, None)]
    return spark.createDataFrame(rows, "target_id long, seq string, len int")


@pytest.mark.parametrize("algorithm", ["nw", "sw"])
@pytest.mark.parametrize("engine", ["vector", "scalar", "native"])
def test_search(targets, algorithm, engine):
    queries = {"a": "HEAGAWGHEE", "b": "MKVLAW", "empty": ""}
    got = {(r.query_id, r.target_id): r.score for r in search(targets, queries, algorithm, threshold=10, engine=engine).collect()}
    for name, q in queries.items():
        for i, s in enumerate(SEQS):
            assert got[name, i] == K.scalar(algorithm, encode(q), encode(s)), (name, s)
    if engine != "native":
        assert got["a", 99] is None


def test_threshold_and_partitions_change_nothing(targets):
    gold = search(targets, "PAWHEAE", "nw")
    for threshold, parts in ((1, 1), (7, 3), (10**6, 5)):
        V.check(gold, search(targets, "PAWHEAE", "nw", threshold, partitions=parts), "other")
    with pytest.raises(AssertionError):
        V.check(gold, gold.withColumn("score", F.col("score") + 1), "wrong")


def test_arguments(targets):
    for bad in ({"algorithm": "xx"}, {"threshold": 0}, {"num_seqs": 0}, {"max_query": 2}, {"gap_open": 1, "gap_extend": 2}):
        with pytest.raises(ValueError):
            search(targets, "ARND", **bad)


def test_shortest_first(targets):
    got = search(targets, "ARND", "sw", num_seqs=3).select("target_id").collect()
    assert {r[0] for r in got} == {1, 5, 7}


def test_empty_database(spark):
    assert search(spark.createDataFrame([], "target_id long, seq string, len int"), "ARND").count() == 0


def test_top_hits(targets):
    scores = search(targets, "HEAGAWGHEE", "sw")
    got = [(r["rank"], r.target_id) for r in top_hits(scores, 3).orderBy("rank").collect()]
    assert got[:2] == [(1, 3), (2, 8)] and len(got) == 3


def test_encode_column(spark):
    df = spark.createDataFrame([("ARNDcq",), ("JOU*?",), ("",), ("ı",)], "s string")
    assert [list(r[0]) for r in df.select(encode_column(F.col("s"))).collect()] == [[0, 1, 2, 3, 4, 5], [23] * 5, [], [23]]


def test_layout(spark):
    db = spark.createDataFrame([(i, n) for i, n in enumerate([1, 2, 3, 4])], "target_id long, len int")
    routes = {r.len: r.route for r in L.routed(db, 3).collect()}
    assert routes == {1: "small", 2: "small", 3: "large", 4: "large"}
    rows = L.positioned(db).orderBy("ord").collect()
    assert [r.start for r in rows] == [0, 1, 3, 6]
    batch = L.batch_layout(L.positioned(db)).collect()[0]
    assert (batch.width, batch.cells, batch.padding) == (4, 128, 118)
    assert L.hash_sample(db, 2, 1).collect() == L.hash_sample(db, 2, 1).collect()
    assert L.hash_sample(db, 9).count() == 4


def _greedy(rows, query_len, budget):
    out, batch, used = {}, 0, 0
    for i, n in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0] is None, r[0] or 0)):
        w = 3 * (query_len + 1) * ((n or 0) + 1)
        if used and used + w > budget:
            batch, used = batch + 1, 0
        used += w
        out[i] = batch
    return out


@pytest.mark.parametrize("budget", [1, 90, 150, 1000, 4000, 10**9])
def test_budget_batches(spark, budget):
    """Greedy over the whole length order, whatever the partitions."""
    import random

    r = random.Random(budget)
    rows = [(i, r.choice([0, 1, 2, 2, 2, 3, 7, 7, 30, 200, None])) for i in range(150)]
    want = _greedy(rows, 9, budget)
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "target_id long, len int").repartition(parts)
        got = L.budget_batches(df, 9, budget)
        assert {x.target_id: x.budget_batch for x in got.collect()} == want
    columns = {b: sum((n or 0) + 1 for i, n in rows if want[i] == b) for b in set(want.values())}
    sizes = {b: list(want.values()).count(b) for b in columns}
    assert tuple(L.largest_allocation(got).first()) == (len(columns), max(columns.values()), max(sizes.values()))


def test_n_shortest_without_a_gathering(spark):
    import random

    r = random.Random(2)
    rows = [(i, r.choice([None, 1, 2, 2, 3, 3, 3, 9])) for i in range(200)]
    df = spark.createDataFrame(rows, "target_id long, len int").repartition(4)
    for n in (1, 30, 77, 150, 199, 200, 500):
        few, many = (sorted(map(repr, L.n_shortest(df, n, gather=g).collect())) for g in (10**6, 0))
        assert few == many and len(few) == min(n, 200)


def test_positions_of_unevenly_spread_ids(spark):
    """One outlying id, a cluster and nulls: ranges hold about as many rows each, and places are right."""
    ids = [*range(1000), 10**15, *range(5 * 10**9, 5 * 10**9 + 500), None, None, 7, 7]
    df = spark.createDataFrame([(i, 3 + k % 2) for k, i in enumerate(ids)], "target_id long, len int")
    sizes = {r["_part"]: r["count"] for r in L._ranged(df, "target_id", 20).groupBy("_part").count().collect()}
    assert len(sizes) >= 20 and max(sizes.values()) < 160 and sizes[None] == 2
    got = sorted((r.ord, r.len, r.target_id, r.start) for r in L.positioned(df).collect())
    order = sorted(((3 + k % 2, i is None, i or 0) for k, i in enumerate(ids)))
    start = 0
    for (place, n, i, at), (want, none, want_id) in zip(got, order, strict=True):
        assert (n, i, at) == (want, None if none else want_id, start) and got[place][0] == place
        start += n
    assert L.positioned(df.where("target_id < 0")).collect() == []
    assert sorted(r.ord for r in L.positioned(df.where("target_id = 7")).collect()) == [0, 1, 2]


def test_offsets_in_blocks(spark):
    layout = spark.createDataFrame([(b, 32, 3 + b % 5) for b in range(50)], "batch long, n long, width int")
    rows = sorted(L.batch_offsets(layout, block=7).collect())
    r = c = 0
    for x in rows:
        assert (x.residue_start, x.row_start) == (r, c)
        r, c = r + x.width * 32, c + (x.width + 1) * 64


def test_plans_do_not_gather_rows(spark):
    """Windows without a partition see a row for each length or block, never one for each sequence or batch."""
    df = spark.range(100).selectExpr("id AS target_id", "CAST(id % 7 AS INT) AS len")
    for made in (L.positioned(df), L.batch_offsets(L.batch_layout(L.positioned(df))), L.budget_batches(df, 9, 1000)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.splitlines():
            if "Window [" in line and "RowFrame" in line:
                assert "_in#" in line or "_block" in line or "], [" in line.split("windowspecdefinition")[-1] or line.rstrip().count("[") >= 3, line


def test_search_scores_where_it_reads(spark, tmp_path):
    """No sequence of a database of size is shuffled; a small one is dealt over all tasks."""
    from loomalign.operators import search as S

    fasta_rows = spark.range(64).selectExpr("id AS target_id", "repeat('ARND', 1 + CAST(id AS INT)) AS seq", "4 * (1 + CAST(id AS INT)) AS len")
    fasta_rows.write.parquet(str(tmp_path / "db"))
    db = spark.read.parquet(str(tmp_path / "db"))
    small = search(db, "ARND")._jdf.queryExecution().executedPlan().toString()
    old, S.SMALL = S.SMALL, 0
    try:
        large = search(db, "ARND")
        assert "Exchange" in small and "Exchange" not in large._jdf.queryExecution().executedPlan().toString().split("Union")[0].replace("Union", "")
        V.check(search(db, "ARND"), large, "straight")
    finally:
        S.SMALL = old


@pytest.mark.parametrize("costs", [(10, 1), (5, 2), (3, 3), (14, 0)])
@pytest.mark.parametrize("algorithm", ["nw", "sw"])
def test_narrow_first(spark, costs, algorithm):
    """Equal to one search, for any gap costs, limit and engine; null sequences keep their row."""
    import random

    r = random.Random(sum(costs))
    rows = [(i, "".join(r.choices("ARNDCQEGHILKMFPSTWYV", k=r.choice([0, 3, 20, 60, 200])))) for i in range(60)] + [(100, None)]
    targets = spark.createDataFrame([(i, s, None if s is None else len(s)) for i, s in rows], "target_id long, seq string, len int")
    queries = {"a": "HEAGAWGHEE", "b": "MKVLAWHEAGAWGHEEARND"}
    options = {"gap_open": costs[0], "gap_extend": costs[1]}
    gold = search(targets, queries, algorithm, **options)
    for limit in (60, 300, None):
        got = narrow_first(targets, queries, algorithm, limit=limit, **options)
        assert got.count() == gold.count() == 2 * len(rows)
        V.check(gold, got, "in two steps")
    n = narrow_first(targets, queries, algorithm, limit=100, num_seqs=20, **options)
    V.check(search(targets, queries, algorithm, num_seqs=20, **options), n, "shortest")


def test_narrow_kernels_equal_wide_ones():
    import numpy as np

    r = np.random.default_rng(5)
    for k in range(120):
        q = r.integers(0, 24, r.integers(0, 40)).astype(np.uint8)
        targets = [r.integers(0, 24, r.integers(0, 700)).astype(np.uint8) for _ in range(6)]
        extend = int(r.integers(0, 6))
        costs = extend + int(r.integers(0, 12)), extend
        a = ("nw", "sw")[k % 2]
        wide = [K.within(a, q, t, *costs, wide=True) for t in targets]
        assert wide == [K.within(a, q, t, *costs) for t in targets] == K.along(a, q, targets, *costs).tolist()
        assert wide == K.between(a, q, targets, *costs).tolist() == K.between(a, q, targets, *costs, wide=True).tolist()
        assert wide == K.scores(a, q, targets, 100, *costs).tolist()
    same = np.full(2900, 17, np.uint8)  # as high as a score gets: beyond 16 bits
    assert K.within("sw", same, same) == 2900 * 11 == K.scores("sw", same, [same, same[:50]], 10).tolist()[0]


def test_metrics(spark):
    rows = [("sw", 64, "a", 2000.0, 10**9, 0.5, None), ("sw", 128, "a", 1000.0, 10**9, 1.0, None), ("sw", 64, "b", 4000.0, 10**9, 0.25, None), ("sw", 128, "b", 500.0, 10**9, 2.0, 8)]
    m = spark.createDataFrame(rows, "algorithm string, query_len int, impl string, latency_ms double, cells long, gcups double, threshold int")
    assert V.gcups(10**9, 2000.0) == 0.5
    assert {(r.query_len, r.impl): r.speedup for r in V.speedup(m, "a").collect()} == {(64, "a"): 1, (128, "a"): 1, (64, "b"): 0.5, (128, "b"): 2}
    assert V.crossover(m, "b", "a").first().query_len == 128
    assert V.best_threshold(m).first().threshold == 8
    assert {r.impl: r.query_len for r in V.peak(m).collect()} == {"a": 128, "b": 128}
    assert V.sweep(lambda a, b: {"c": a + b}, a=[1, 2], b=[3]) == [{"a": 1, "b": 3, "c": 4}, {"a": 2, "b": 3, "c": 5}]


#: Scores of nucleotides that are equal and that are not.
DNA = """
   A  C  G  T
A  5 -4 -4 -4
C -4  5 -4 -4
G -4 -4  5 -4
T -4 -4 -4  5
"""


@pytest.mark.parametrize("algorithm", ["sw", "nw"])
@pytest.mark.parametrize("scale", [1, 900])
def test_other_matrices(spark, algorithm, scale):
    """A matrix as data: three engines and queries in a table agree, also where its scores leave 16 bits soon."""
    r = np.random.default_rng(31)
    query = "".join(r.choice(list("ACGT"), 45))
    rows = [(i, "".join(r.choice(list("ACGTN"), int(n)))) for i, n in enumerate(r.integers(0, 60, 60))] + [(5000, "NN" + query)]
    df = spark.createDataFrame(rows, "target_id long, seq string").withColumn("len", F.octet_length("seq"))
    matrix = read_matrix(DNA, other=-4) * scale
    assert matrix[0, 0] == 5 * scale and matrix[0, 1] == -4 * scale and read_matrix(BLOSUM62).tolist() == MATRIX.tolist()
    want = {i: kernels.scalar(algorithm, encode(query), encode(s), 10, 1, matrix) for i, s in rows}
    assert max(want.values()) > (30_000 if scale > 1 else 10)
    for engine in ("vector", "scalar", "native"):
        few = df if engine != "native" else df.where("target_id < 12")
        got = {x.target_id: x.score for x in search(few, query, algorithm, threshold=20, engine=engine, matrix=matrix).collect()}
        assert got == {i: v for i, v in want.items() if i in got} and len(got) == few.count(), engine
    table = spark.createDataFrame([("q", query)], "query_id string, seq string")
    assert {x.target_id: x.score for x in search(df, table, algorithm, matrix=matrix).collect()} == want
    assert {x.target_id: x.score for x in narrow_first(df, query, algorithm, matrix=matrix).collect()} == want
    t = [encode(s) for _, s in rows]
    assert kernels.along(algorithm, encode(query), t, matrix=matrix).tolist() == kernels.between(algorithm, encode(query), t, matrix=matrix).tolist() == list(want.values())
