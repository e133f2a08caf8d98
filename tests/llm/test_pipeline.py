"""The pipeline: each stage on its own against a brute-force version, then the whole; odd and empty tables."""

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest

import corpus_pipeline as P
from loomalign.llm import quality_rules

W = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns = docs.columns
    before = docs.toPandas()
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, corpus)
        after = out.toPandas()
        if k < 4:
            assert out.columns == columns, name
        globals()[f"check_{name}"](before, after, spark, corpus)
        path = f"{spark.conf.get('spark.sql.warehouse.dir')}/stage-{k}"
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        before = docs.toPandas()
    whole = P.run(spark, corpus).toPandas()
    assert sorted(map(tuple, whole.drop(columns=["sequence_id", "offset"]).to_numpy().tolist())) == sorted(map(tuple, before.drop(columns=["sequence_id", "offset"]).to_numpy().tolist()))


def check_quality_rules(before, after, spark, corpus):
    field = quality_rules.fit(spark, corpus)
    verdict = quality_rules.judged(spark.read.parquet(f"{corpus}/documents.parquet"), field).toPandas()
    assert set(after.doc_id) == set(verdict.doc_id[verdict.kept])
    assert not after.text.str.contains(r"\*\*\*|\$\$\$").any()


def check_ngram_join(before, after, spark, corpus):
    sets = {}
    for i, t in zip(before.doc_id, before.text, strict=True):
        w = W.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                least[max(x, y)] = min(x, y)
    assert set(after.doc_id) == {i for i in sets if root(i) == i}


def check_substring_dedup(before, after, spark, corpus):
    raw = {i: t.encode() for i, t in zip(before.doc_id, before.text, strict=True)}
    count = Counter(hash(b[k : k + 400]) for b in raw.values() for k in range(len(b) - 399))
    got = after.set_index("doc_id")
    assert len(after) == len(before) and (after.n_chars == after.text.str.len()).all()
    for i, b in raw.items():
        cover = np.zeros(len(b) + 1, int)
        for k in range(len(b) - 399):
            if count[hash(b[k : k + 400])] > 1:
                cover[k] += 1
                cover[k + 400] -= 1
        keep = np.cumsum(cover[:-1]) == 0
        assert got.text[i] == np.frombuffer(b, np.uint8)[keep].tobytes().decode("utf-8", "ignore")


def check_mixing(before, after, spark, corpus):
    size = before.text.map(lambda t: len(W.findall(t)))
    assert set(after.doc_id) <= set(before.doc_id) and after.groupby("doc_id").size().max() <= 2
    total = after.text.map(lambda t: len(W.findall(t))).sum()
    assert 0.8 * 1.5 * size.sum() < total < 1.2 * 1.5 * size.sum()


def check_packing(before, after, spark, corpus):
    assert Counter(before.doc_id) == Counter(after[after.piece == 0].doc_id)
    for _, g in after.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 2048 and (g.offset == g.length.cumsum() - g.length).all()
    assert after.sequence_id.nunique() <= -(-after.length.sum() // 2048) + 2


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_odd_tables(spark, which, request):
    d = request.getfixturevalue(which)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, d)
        rows = out.collect()
        assert (k == 4 or out.columns == docs.columns) and (which == "odd" or rows == [])
    P.run(spark, d).collect()


def test_clean_documents_stay(spark, corpus):
    docs = pd.DataFrame(pq.read_table(f"{corpus}/documents.parquet").to_pandas())
    kept = {r.doc_id for r in P.STAGES[0][1](spark, spark.read.parquet(f"{corpus}/documents.parquet"), corpus).select("doc_id").collect()}
    assert len(kept & set(docs.doc_id[:150])) >= 147
