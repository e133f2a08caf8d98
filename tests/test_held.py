"""What a task holds of many short targets has a bound, and few partitions are dealt over all tasks."""

from loomalign.operators import bounded, search


def test_short_targets_count_for_more_than_their_residues(spark, monkeypatch):
    plain = bounded._counts

    def few(seqs):
        if len(seqs) > 10:
            raise ValueError(f"{len(seqs)} targets at a time")
        return plain(seqs)

    names = ["large ring", "blue steel", "HEAGAW", "W"]
    rows = [(i, names[i % 4], len(names[i % 4])) for i in range(400)]
    targets = spark.createDataFrame(rows, "target_id long, seq string, len int").coalesce(1)
    want = [tuple(r) for r in search.top_hits(search.search(targets, "HEAGAWGHEE", "sw"), 7).collect()]
    monkeypatch.setattr(bounded, "_counts", few)
    monkeypatch.setattr(bounded, "HELD", 9 * search.EACH)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        got = [tuple(r) for r in bounded.bounded_top_hits(targets, "HEAGAWGHEE", 7)[0].collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got) == sorted(want) and len(got) == 7


def test_a_small_scan_is_dealt(spark):
    targets = spark.range(100).selectExpr("id as target_id", "'A' as seq", "1 as len").coalesce(1)
    assert search.spread(targets).rdd.getNumPartitions() == 4
    assert search.spread(targets, 7).rdd.getNumPartitions() == 7


def test_gaps_pass_from_one_block_of_rows_to_the_next():
    """A batch so large that a column of it takes several blocks of the query's rows."""
    import numpy as np

    from loomalign.functions.scoring import encode
    from loomalign.operators import kernels

    q, names = encode("ARNDCQEGHILKMFPSTWYV"), [encode(x) for x in ("hot rod", "red rod", "small widget", "W")]
    for algorithm in ("nw", "sw"):
        want = np.array([kernels.scalar(algorithm, q, t, 2, 1) for t in names])
        assert (kernels.between(algorithm, q, names * 5000, 2, 1) == np.tile(want, 5000)).all()


def test_path_of_a_repeated_pair_is_remembered():
    from loomalign.functions import callable as callables

    before = callables._recent.cache_info()
    rows = [tuple(callables.align_path.func().eval("HEAGAWGHEE", "PAWHEAE", "nw")) for _ in range(3)]
    after = callables._recent.cache_info()
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == 1 and after.hits - before.hits >= 2
    assert not list(callables.align_path.func().eval("A", None, "nw"))
    assert list(callables.align_path.func().eval("A" * 300, "A" * 300, "nw"))[0][7] == 1200 and callables._recent.cache_info().currsize == after.currsize


def test_sql_paths_are_dealt(spark, tmp_path):
    from loomalign.plans import queries

    spark.createDataFrame([(1, "ring")], "p_partkey long, p_name string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = queries.sql_paths(spark, str(tmp_path))
    assert "Repartition" in got._jdf.queryExecution().optimizedPlan().toString() and got.count() == 1
