"""The expression engine: equal sequences are folded once, over all tasks."""

import numpy as np
import pytest

from loomalign.functions.scoring import ALPHABET, MATRIX, encode
from loomalign.operators import kernels
from loomalign.operators.search import search


@pytest.mark.parametrize("algorithm", ["sw", "nw"])
def test_scores_of_equal_and_odd_sequences(spark, algorithm):
    r = np.random.default_rng(8)
    seqs = ["", "A", "W", "*", "é!", *("".join(r.choice(list(ALPHABET), int(n))) for n in r.integers(1, 25, 20))]
    rows = [(i, seqs[i % len(seqs)], len(seqs[i % len(seqs)])) for i in range(3 * len(seqs))]
    targets = spark.createDataFrame(rows, "target_id long, seq string, len int")
    matrix = np.tril(MATRIX)  # query and target are not to be exchanged
    queries = {"a": "HEAGAWGHEE", "b": "", "c": "W"}
    for open_, extend in ((10, 1), (3, 3), (2, 0)):
        got = search(targets, queries, algorithm, engine="native", gap_open=open_, gap_extend=extend, matrix=matrix)
        assert got.columns == ["query_id", "target_id", "algorithm", "len", "route", "score"]
        got = {(x.query_id, x.target_id): x.score for x in got.collect()}
        assert len(got) == 3 * len(rows)
        for i, seq, _ in rows:
            t = encode("X" + "!" if seq == "é!" else seq)  # by characters
            assert all(got[name, i] == kernels.scalar(algorithm, encode(q), t, open_, extend, matrix) for name, q in queries.items())


def test_each_sequence_is_folded_once(spark):
    """The fold stands once for each query, over dealt distinct sequences, and no filter repeats it."""
    targets = spark.createDataFrame([(i, "large ring", 10) for i in range(50)], "target_id long, seq string, len int")
    plan = search(targets, {"a": "HEAG", "b": "WW"}, "nw", engine="native")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    folds = [k for k, line in enumerate(plan) if "aggregate(sequence" in line]
    assert len(folds) == 1 and plan[folds[0]].count("aggregate(sequence") == 2
    below = "\n".join(plan[folds[0] + 1 :])
    assert "Repartition 4" in below and "Aggregate [seq" in below
