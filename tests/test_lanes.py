"""Tiles side by side, edges in bytes, texts with themselves."""

import numpy as np
import pytest

from loomalign.functions.scoring import MATRIX, encode
from loomalign.operators import kernels, lanes, tiled


def _group(r, local, open_, extend, k):
    tiles, want = [], []
    for _ in range(int(r.integers(1, 5))):
        m, n = r.integers(1, 200, 2)
        q, t = r.integers(0, 24, m).astype(np.uint8), r.integers(0, 24, n).astype(np.uint8)
        if k % 3:  # a good alignment
            t = np.concatenate((q, t))[int(r.integers(0, 5)) :]
        top, left = tiled.outer_edge(local, 0, len(t), open_, extend), tiled.outer_edge(local, 0, len(q), open_, extend)
        tiles.append(lanes.Tile(q, t, top, left))
        want.append(tiled.tile(q, t, top, left, local, open_, extend))
    return tiles, want


@pytest.mark.parametrize("local", [True, False])
def test_tiles_side_by_side(local):
    """Cells along the edges and best cells are those of each tile by itself, for any gap costs, bands and types."""
    r = np.random.default_rng(1)
    for k in range(150):
        open_ = int(r.integers(1, 12)) if k % 17 else 40
        extend = int(r.integers(0, open_ + 1))
        tiles, want = _group(r, local, open_, extend, k)
        assert lanes.align(tiles, local, open_, extend, k % 5 == 0, True, int(r.integers(1, 40)))
        for x, (lower, right, best) in zip(tiles, want, strict=True):
            assert (x.lower[0] == lower[0]).all() and (x.right[0] == right[0]).all() and (not local or x.best == best)
            assert len(x.lower[1]) == len(x.t) and len(x.right[1]) == len(x.q)


@pytest.mark.parametrize("local", [True, False])
def test_tiles_side_by_side_in_turn(local):
    """Scores of pairs cut into tiles: gaps pass every edge."""
    r = np.random.default_rng(2)
    for k in range(60):
        m, n = r.integers(1, 90, 2)
        q, t = r.integers(0, 24, m).astype(np.uint8), r.integers(0, 24, n).astype(np.uint8)
        t = np.concatenate((q[: m // 2], t, q[m // 2 :])) if k % 2 else t
        open_ = int(r.integers(1, 12))
        extend, side = int(r.integers(0, open_ + 1)), int(r.integers(3, 40))
        tops, lefts, best = {}, {}, 0
        for a in range(0, len(q), side):
            for b in range(0, len(t), side):
                top = tops[b] if a else tiled.outer_edge(local, b, len(t[b : b + side]), open_, extend)
                left = lefts[a] if b else tiled.outer_edge(local, a, len(q[a : a + side]), open_, extend)
                x = lanes.Tile(q[a : a + side], t[b : b + side], top, left)
                assert lanes.align([x], local, open_, extend)
                tops[b], lefts[a], best = x.lower, x.right, max(best, x.best)
        score = best if local else int(tops[b][0][-1])
        assert score == kernels.scalar("sw" if local else "nw", q, t, open_, extend)


@pytest.mark.parametrize("local", [True, False])
def test_scores_beyond_16_bits(local):
    """A long text and nearly itself: the edges no longer prove 16 bits enough."""
    q = np.random.default_rng(3).integers(0, 20, 9000).astype(np.uint8)
    t = np.concatenate((q[:4000], q[4100:]))
    x = lanes.Tile(q, t, tiled.outer_edge(local, 0, len(t)), tiled.outer_edge(local, 0, len(q)))
    assert lanes.align([x], local)
    want = kernels.within("sw" if local else "nw", q, t)
    assert want > 32_767 and (x.best if local else int(x.lower[0][-1])) == want


def test_low_scores_go_by_bytes(monkeypatch):
    """Rows by bytes until a cell might not fit, and again where none can; the edges and best cells stay the same."""
    calls = {"_low_band": 0, "_band": 0}

    def counted(name, kept):
        def call(*args):
            calls[name] += 1
            return kept(*args)

        return call

    for name in calls:
        monkeypatch.setattr(lanes, name, counted(name, getattr(lanes, name)))
    r = np.random.default_rng(6)
    for k in range(80):
        tiles, want = [], []
        for _ in range(int(r.integers(1, 5))):
            m, n = r.integers(1, 400, 2)
            q, t = r.integers(0, 24, m).astype(np.uint8), r.integers(0, 24, n).astype(np.uint8)
            for _ in range(k % 4):
                i, j = int(r.integers(0, m)), int(r.integers(0, n))
                size = min(int(r.integers(5, 70)), m - i, n - j)
                t[j : j + size] = q[i : i + size]
            top, left = tiled.outer_edge(True, 0, len(t)), tiled.outer_edge(True, 0, len(q))
            tiles.append(lanes.Tile(q, t, top, left))
            want.append(tiled.tile(q, t, top, left, True))
        assert lanes.align(tiles, True, band=int(r.integers(1, 80)))
        for x, (lower, right, best) in zip(tiles, want, strict=True):
            assert (x.lower[0] == lower[0]).all() and (x.right[0] == right[0]).all() and x.best == best
    assert calls["_low_band"] > 100 and calls["_band"] > 20
    x = lanes.Tile(q, t, top, left)
    lanes.align([x], True, 11, 1)  # other gap costs do not go by bytes
    assert x.best == kernels.scalar("sw", q, t, 11, 1)


@pytest.mark.parametrize("wide", [True, False])
def test_best_cells_that_come_in_from_the_left(wide):
    """A good alignment of the tile, then a better one that enters and ends between two looks at the best cell."""
    r = np.random.default_rng(7)
    for k in range(120):
        q, t = r.integers(0, 20, 300).astype(np.uint8), np.full(400, 17, np.uint8)
        q[110:] = 18
        t[300:340] = q[5:45]
        passes, end = 1 + k // 4 % 6, 88 + 3 * (k % 4)  # residues of the better one beyond the edge, the row that it ends before
        size = 42 + k % 3
        t[200 + passes - size : 200 + passes] = q[end - size : end]
        q[end:] = 18
        first = lanes.Tile(q, t[:200], tiled.outer_edge(True, 0, 200), tiled.outer_edge(True, 0, 300))
        assert lanes.align([first], True, wide=wide)
        second = lanes.Tile(q, t[200:], tiled.outer_edge(True, 200, 200), first.right)
        assert lanes.align([second], True, wide=wide)
        assert max(first.best, second.best) == kernels.within("sw", q, t)


def test_groups_are_bounded():
    side = lambda n: (np.zeros(n + 1, np.int64), np.zeros(n, np.int64))
    tiles = [lanes.Tile(np.zeros(m, np.uint8), np.zeros(n, np.uint8), side(n), side(m)) for m, n in [(3, 40), (9, 70), (5, 50), (1, 200)]]
    assert [[len(x.q) for x in g] for g in lanes.groups(tiles, 120)] == [[9, 5], [3], [1]]


def test_edges_in_bytes():
    r = np.random.default_rng(4)
    for top in (20, 2000):
        h = np.cumsum(r.integers(-10, top, 50))
        g = h[1:] - r.integers(0, 30, 49)
        first, steps, drops = tiled.packed((h, g))
        assert len(steps) == (49 if top == 20 else 49 * 8)
        back = tiled.unpacked(first, steps, drops, 49)
        assert (back[0] == h).all() and (back[1] == g).all()


def test_a_text_with_itself():
    """No pair of residues scores more than the mean of their own scores: the diagonal is the best."""
    own = MATRIX.diagonal()
    assert (2 * MATRIX <= own[:, None] + own).all() and own.min() == -1
    r = np.random.default_rng(5)
    for k in range(60):
        q = r.integers(0, 24, int(r.integers(1, 60))).astype(np.uint8)
        if k % 2:
            q[r.random(len(q)) < 0.6] = 22  # X, which costs even with itself
        for local, name in ((True, "sw"), (False, "nw")):
            assert tiled.with_itself(q, local) == kernels.scalar(name, q, q) and tiled.with_itself(q, local) == kernels.scalar(name, q, q, 1, 1)


@pytest.mark.parametrize("algorithm", ["sw", "nw"])
def test_texts_with_themselves_are_not_cut(spark, algorithm, monkeypatch):
    """Unless gaps can be longer for nothing."""
    cut = []
    kept = tiled._cut
    monkeypatch.setattr(tiled, "_cut", lambda pairs, *rest: cut.append(pairs.count()) or kept(pairs, *rest))
    rows = [(1, "HEAGAXXXXXXWGHEE" * 9, "HEAGAXXXXXXWGHEE" * 9), (2, "PAWHEAE" * 9, "HEAGAWGHEE" * 9), (3, "XX", "XX"), (4, None, None)]
    pairs = spark.createDataFrame(rows, "pair long, query string, target string")
    for extend, count in ((1, 1), (0, 3)):
        got = {r.pair: r.score for r in tiled.massive_pairs(pairs, algorithm, side=32, gap_open=3, gap_extend=extend).collect()}
        assert got == {k: None if q is None else int(kernels.scalar(algorithm, encode(q), encode(t), 3, extend)) for k, q, t in rows}
        assert cut == [count, count]
        cut.clear()


@pytest.mark.parametrize("algorithm", ["sw", "nw"])
@pytest.mark.parametrize("gaps", [(1 << 33, 1), (40_000, 300)])
def test_any_gap_costs(spark, algorithm, gaps):
    """Costs beyond 16 and beyond 32 bits."""
    r = np.random.default_rng(8)
    word = lambda n: "".join(r.choice(list("ARNDCQEGHILKMFPSTWYV"), n))
    core = word(50)
    rows = [(1, word(20) + core, core + word(60)), (2, word(70), word(70))]
    pairs = spark.createDataFrame(rows, "pair long, query string, target string")
    got = {r.pair: r.score for r in tiled.massive_pairs(pairs, algorithm, side=32, gap_open=gaps[0], gap_extend=gaps[1]).collect()}
    assert got == {k: scalar(algorithm, q, t, *gaps) for k, q, t in rows}


def scalar(algorithm, q, t, open_, extend):
    """The definition in whole numbers of any size."""
    q, t, local = encode(q), encode(t), algorithm == "sw"
    gap = lambda k: open_ + (k - 1) * extend if k else 0
    above = [0 if local else -gap(j) for j in range(len(t) + 1)]
    f, best = [-(1 << 60)] * (len(t) + 1), 0
    for i, a in enumerate(q, 1):
        row, e = [0 if local else -gap(i)], -(1 << 60)
        for j, b in enumerate(t, 1):
            e = max(e - extend, row[-1] - open_)
            f[j] = max(f[j] - extend, above[j] - open_)
            row.append(max(above[j - 1] + int(MATRIX[a, b]), e, f[j], *([0] if local else [])))
        above, best = row, max(best, *row)
    return best if local else above[-1]
