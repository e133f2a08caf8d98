"""Wide tiles in bands, running maxima by vectors, equal pairs aligned once."""

import numpy as np
import pytest

from loomalign.operators import kernels, tiled


@pytest.mark.parametrize("n", [1, 2, 127, 129, 1023, 1024, 1025, 1500, 4096])
def test_running_maximum(n):
    r = np.random.default_rng(n)
    x = r.integers(-1000, 1000, n).astype(np.int16)
    want = np.maximum.accumulate(x)
    assert (tiled._running(x.copy(), np.empty_like(x), 1 << 40)[0] == want).all()
    got = tiled._running(x.copy(), np.empty_like(x), 50)[0]
    assert all(x[max(0, i - 49) : i + 1].max() <= got[i] <= want[i] for i in range(n))


@pytest.mark.parametrize("local", [True, False])
def test_bands_are_one_tile(local):
    r = np.random.default_rng(5)
    q = r.integers(0, 20, 700).astype(np.uint8)
    t = np.concatenate((q[:300], r.integers(0, 20, 900).astype(np.uint8), q[300:]))
    top, left = tiled.outer_edge(local, 0, len(t)), tiled.outer_edge(local, 0, len(q))
    lower, right, best = tiled.banded(q, t, top, left, local, band=64)
    score = best if local else int(lower[0][-1])
    assert score == kernels.scalar("sw" if local else "nw", q, t)
    assert len(right[0]) == len(q) + 1 and len(right[1]) == len(q) and right[0][-1] == lower[0][-1]


@pytest.mark.parametrize("algorithm", ["sw", "nw"])
def test_equal_pairs_are_aligned_once(spark, algorithm, monkeypatch):
    """A row for each pair; the stretches that go to tasks are those of the different pairs."""
    cut = []
    kept = tiled._cut
    monkeypatch.setattr(tiled, "_cut", lambda pairs, *rest: cut.append(pairs.count()) or kept(pairs, *rest))
    rows = [(k, "HEAGAWGHEE" * 9, "PAWHEAE" * (9 + k % 2)) for k in range(6)] + [(6, None, "A"), (7, "", "AA"), (8, "PAWHEAE" * 9, "HEAGAWGHEE" * 9)]
    pairs = spark.createDataFrame(rows, "pair long, query string, target string")
    got = {r.pair: r.score for r in tiled.massive_pairs(pairs, algorithm, side=32).collect()}
    code = tiled.encode
    want = {k: None if q is None else int(kernels.within(algorithm, code(q), code(t))) for k, q, t in rows}
    assert got == want and cut == [3, 3]


def test_rounds_follow_the_side():
    """Two texts of 52,000 and 134,000 residues, as at sf0.1, take 12 rounds."""
    assert sum(-(-n // tiled.SIDE) for n in (52_221, 133_719)) - 1 == 12
