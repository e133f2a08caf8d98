import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomalign.functions.scoring import ALPHABET, MATRIX, encode
from loomalign.operators import kernels as K

GOLDEN = [
    ("ARND", "ARND", 21, 21), ("ARND", "arnd", 21, 21), ("ARNDCQEGHILKMFPSTWYV", "ARNDCQEGHILKMFPSTWYV", 116, 116),
    ("HEAGAWGHEE", "PAWHEAE", 3, 18), ("W", "W", 11, 11), ("A", "W", -3, 0), ("ARND", "A", -8, 4), ("A", "ARND", -8, 4),
    ("ARNDCQEG", "ARNDEG", 21, 21), ("MKVLAW", "MKVLMKVLMKVLAW", 16, 33), ("JOU*?", "JOU*?", 5, 5), ("BZX*", "BZX*", 8, 8),
    ("", "ARND", -13, 0), ("ARND", "", -13, 0), ("", "", 0, 0),
]
SEQ = st.text(ALPHABET, max_size=40).map(encode)


def test_matrix():
    m = MATRIX.astype(int)
    assert m.shape == (24, 24) and (m == m.T).all() and m.sum() == -726 and np.trace(m) == 124 and (m.min(), m.max()) == (-4, 11)


def test_alphabet():
    assert encode(ALPHABET[:20]).tolist() == list(range(20))
    assert encode(ALPHABET.lower()).tolist() == list(range(24))
    assert encode("JOU*? 1é").tolist() == [23] * 9


@pytest.mark.parametrize(("q", "t", "nw", "sw"), GOLDEN)
def test_golden(q, t, nw, sw):
    q, t = encode(q), encode(t)
    for algorithm, want in (("nw", nw), ("sw", sw)):
        assert K.scalar(algorithm, q, t) == K.within(algorithm, q, t) == want
        assert K.between(algorithm, q, [t, t[:1], t]).tolist()[::2] == [want, want]


@settings(max_examples=40, deadline=None)
@given(SEQ, st.lists(SEQ, max_size=30), st.sampled_from(["nw", "sw"]))
def test_kernels_agree(q, ts, algorithm):
    want = [K.scalar(algorithm, q, t) for t in ts]
    assert K.between(algorithm, q, ts).tolist() == want
    assert [K.within(algorithm, q, t) for t in ts] == want
    for threshold in (1, 10, 1000):
        assert K.scores(algorithm, q, ts, threshold).tolist() == want


@settings(max_examples=40, deadline=None)
@given(SEQ, SEQ)
def test_properties(a, b):
    nw, sw = K.scalar("nw", a, b), K.scalar("sw", a, b)
    assert (K.scalar("nw", b, a), K.scalar("sw", b, a)) == (nw, sw)
    assert sw >= max(0, nw)
    assert (K.scalar("nw", a[::-1], b[::-1]), K.scalar("sw", a[::-1], b[::-1])) == (nw, sw)
    if 22 not in a:
        assert K.scalar("sw", a, a) == sum(int(MATRIX[x, x]) for x in a)


def test_wide_cells():
    w = encode("W" * 3100)
    assert not K.narrow("sw", 3100, 3100) and K.between("sw", w, [w] * 2).tolist() == [34100] * 2 == [K.within("sw", w, w)] * 2
    assert K.within("nw", encode("A"), encode("A" * 40000)) == 4 - 10 - 39998


def test_batches():
    assert K.batches([], 5) == []
    assert K.batches([3, 4, 5], 10, most=2) == [(0, 2), (2, 3)]
    assert K.batches([10**9], 10) == [(0, 1)]


def test_other_gaps():
    q, ts = encode("MKVLAWMKV"), [encode("MKVLMKVLMKVLAW"), encode("AWMK")] * 15
    for algorithm in ("nw", "sw"):
        want = [K.scalar(algorithm, q, t, 5, 2) for t in ts]
        assert K.between(algorithm, q, ts, 5, 2).tolist() == want == [K.within(algorithm, q, t, 5, 2) for t in ts]


def test_encode_all():
    import pyarrow as pa

    from loomalign.functions.scoring import encode, encode_all

    rows = ["ARND", "", "é*x", "heag~"]
    for column in (pa.array(rows), pa.array(["skip", *rows])[1:], pa.chunked_array([rows[:2], rows[2:]]), pa.array([], pa.string())):
        got = encode_all(column)
        assert [g.tolist() for g in got] == [encode(s).tolist() for s in column.to_pylist()]


def test_batches_bound_their_table():
    """Many short sequences and some very long ones never share a table of codes as wide as the longest."""
    from loomalign.operators.kernels import batches

    lengths = sorted([50] * 9000 + [35_000] * 40)
    parts = batches(lengths, 100)
    assert [a for a, _ in parts] == [0, *[b for _, b in parts[:-1]]] and parts[-1][1] == len(lengths)
    assert all((b - a) * lengths[b - 1] <= 1 << 26 for a, b in parts)
