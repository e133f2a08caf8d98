"""Every query with SQL, held against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    got, want = entry.queries()[name](spark, DATA).toPandas(), duck.sql(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want)
    for c in columns:
        a, b = (df.sort_values(columns)[c].reset_index(drop=True) for df in (got, want))
        assert (a.isna() == b.isna()).all()
        a, b = a.dropna(), b.dropna()
        if a.dtype.kind == "f":
            assert np.allclose(a, b.astype(float), rtol=1e-12)
        else:
            assert (a.astype(b.dtype) == b).all(), c


def test_documents(spark):
    """Without SQL, as whole texts are too many cells for it."""
    from loomalign.functions.scoring import encode
    from loomalign.operators import kernels
    from loomalign.plans.queries import QUERY

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for name in ("sw_documents", "nw_documents"):
        got = {r.target_id: r.score for r in entry.queries()[name](spark, DATA).collect()}
        assert set(got) == set(texts)
        for i in list(texts)[:12]:
            t = encode(texts[i])
            assert got[i] == (kernels.scalar(name[:2], encode(QUERY), t) if len(t) < 3000 else kernels.within(name[:2], encode(QUERY), t))


def test_all_parts_are_targets(spark):
    """The queries over parts: a row for each part (and query), the best and the shortest of all parts."""
    ids = {r.p_partkey for r in spark.read.parquet(f"{DATA}/part.parquet").select("p_partkey").collect()}
    for name in ("sw_search_all", "nw_scalar_all", "hybrid_search_all", "self_score_all", "encode_residues_all", "fasta_roundtrip_all"):
        rows = entry.queries()[name](spark, DATA).select("target_id").collect()
        assert len(rows) == len(ids) and {r.target_id for r in rows} == ids, name
    assert entry.queries()["mismatch_summary_all"](spark, DATA).first().pairs == 3 * len(ids)


@pytest.mark.parametrize("name", ["sort_by_length", "prefix_offsets", "batch_layout", "batch_offsets", "padding_waste", "overflow_risk", "budget_batches", "largest_allocation"])
def test_layout_keeps_nulls(spark, tmp_path, name):
    """Documents without text come last, those without id last of their length."""
    import pandas as pd

    texts = ["x" * (k % 9) for k in range(60)] + [None] * 40
    ids = [None if k in (5, 23, 99) else k * 3 for k in range(100)]
    pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "text": texts}).to_parquet(tmp_path / "documents.parquet")
    got = entry.queries()[name](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = c.sql(f"SELECT {', '.join(got.columns)} FROM ({SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_self_score_is_a_local_score(spark, tmp_path):
    """An unknown residue costs at the ends of a name, so the best local alignment leaves it out."""
    import pandas as pd

    names = {1: "X", 2: "XA", 3: "AXA", 4: "A", 5: "A", 6: "WxW"}
    pd.DataFrame({"p_partkey": list(names), "p_name": list(names.values())}).to_parquet(tmp_path / "part.parquet")
    want = {1: 0, 2: 4, 3: 7, 4: 4, 5: 4, 6: 21}
    assert {r.target_id: r.score for r in entry.queries()["self_score_all"](spark, str(tmp_path)).collect()} == want
    got = {r.target_id: r.score for r in entry.queries()["self_score"](spark, str(tmp_path)).collect()}
    assert got == {i: v for i, v in want.items() if i != 5}
    pairs = {(r.query_id, r.target_id): r.score for r in entry.queries()["all_pairs"](spark, str(tmp_path)).collect()}
    assert len(pairs) == 25 and all(pairs[str(i), i] == v for i, v in got.items())


@pytest.mark.parametrize("algorithm", ["sw", "nw"])
def test_massive_documents(spark, algorithm):
    """Every long document with the next longer one: the tiles' scores are the single kernel's."""
    from loomalign.functions.scoring import encode
    from loomalign.operators import kernels
    from loomalign.plans.queries import MASSIVE

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() if r.text and len(r.text.encode()) >= MASSIVE}
    order = sorted(texts, key=lambda i: (len(texts[i].encode()), i))
    got = {(r.target_id, r.other_id): r.score for r in entry.queries()[f"massive_{algorithm}"](spark, DATA).collect()}
    assert len(order) > 1 and got == {(a, b): int(kernels.within(algorithm, encode(texts[a]), encode(texts[b]))) for a, b in zip(order[:-1], order[1:], strict=True)}


def test_traceback_hits(spark):
    rows = entry.queries()["traceback_hits"](spark, DATA).collect()
    assert len(rows) == 30 and all(r.score == r.path_score and r.q_end - r.q_begin >= r.identities for r in rows)
