"""Periodic runs of words: repeated k-gram masking, then Main-Lorentz on what survives.

A run is a maximal stretch of words with smallest period q that is at least
max(6, 4 q) words long.  Shifted by q it overlaps itself in 5 words or more, so
every word of it lies in a k-gram, k = 5, that its text has twice: words outside
such k-grams cannot be in a run and are masked.  What survives are segments
between masked words.  The recursion of Main and Lorentz halves them; a run
crosses the middle of some node, and how far the equality of words q apart
reaches to both sides of a middle gives it.  Here all nodes, of all segments of a
batch of texts, that can show a period are taken at once: nodes between two and
four periods wide have a middle in every run of that period, from which (or from
one period before it) the equality reaches at least one and a half periods to one
side.  Prefix doubling names the strings of 2^j words, so that one comparison of
names tells; only middles where names agree are followed word by word.  Middles
inside a run whose period divides theirs can only show it again and are left out.

A text costs its surviving words times the square of a logarithm, and memory
linear in them: texts are taken whole, in batches of a bounded number of bytes,
a very long one by itself.

A null text is empty; it, an empty text and one without words have no words and
no run (n_runs 0, four nulls, the digests of empty strings).  Rows without doc_id
and repeated rows are judged each by itself and come out as often as they came
in.  Ties: of runs of equal length the one of smallest start, then of smallest
period.  An empty table gives no rows.  Further columns, whatever their names, are not
read.  Words are compared by 64-bit hashes (over 64 bytes, BLAKE2b).
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: A run is at least LEAST words and POWER periods long.
LEAST, POWER = 6, 4


def overlap(least: int = LEAST, power: int = POWER) -> int:
    """The fewest words in which a run overlaps itself when shifted by its period."""
    return min(max(least, power * q) - q for q in range(1, least + 1))


def survivors(words: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Whether each word lies in a k-gram that its text has twice or more.  ``words`` are hashes, ``first`` each text's first."""
    hashes, at = C.windows(words, first, k)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(at))
    place = np.arange(len(hashes)) - at[doc] + first[doc]
    keyed = hashes ^ C.mixed(doc.astype(np.uint64))
    order = np.argsort(keyed)
    equal = (keyed[order][1:] == keyed[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = np.zeros(len(hashes), bool)
    twice[order[1:]] |= equal
    twice[order[:-1]] |= equal
    cover = np.zeros(len(words) + k + 1, np.int32)
    np.add.at(cover, place[twice], 1)
    np.add.at(cover, place[twice] + k, -1)
    return np.cumsum(cover)[: len(words)] > 0


def _reach(s: np.ndarray, a: int, p: int, step: int) -> int:
    """How many words from a on (step 1), or before a (step -1), equal the word p later."""
    n, got, width = len(s), 0, max(16, p)
    while True:
        if step > 0:
            lo, hi = a + got, min(a + got + width, n - p)
            if lo >= hi:
                return got
            bad = np.flatnonzero(s[lo:hi] != s[lo + p : hi + p])
            if len(bad):
                return got + int(bad[0])
            got += hi - lo
        else:
            lo, hi = max(a - got - width, 0), min(a - got, n - p)
            if lo >= hi:
                return got
            bad = np.flatnonzero(s[lo:hi] != s[lo + p : hi + p])
            if len(bad):
                return got + hi - lo - 1 - int(bad[-1])
            got += hi - lo
        width *= 2


def runs(s: np.ndarray, longest: int | None = None, least: int = LEAST, power: int = POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a string of numbers, by start, then period.

    longest: the length of the longest stretch that a run can lie in, where it is
    known (the string may hold several, ended by numbers of their own).
    """
    n = len(s)
    most = (n if longest is None else longest) // power
    if n < least or most < 1:
        return []
    out: list[tuple[int, int, int]] = []
    # Of each word the last run found to cover it: its start, end and period.
    start, end, period = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, np.int64)
    names = np.unique(s, return_inverse=True)[1].astype(np.int64)
    p = 1
    j = 0
    while p <= most:
        if 2 * ((3 * p) // 2) >= 1 << (j + 2):  # strings of 2^(j+1) words fit in one and a half periods
            m = len(names) - (1 << j)
            if m <= 0:
                break
            pair = names[:m] * (int(names.max()) + 1) + names[1 << j :]
            names = np.unique(pair, return_inverse=True)[1].astype(np.int64)
            j += 1
            continue
        # All periods of this j, with nodes of 2^t words: 2 p <= 2^t < 4 p.
        stop = p
        while stop <= most and (3 * stop) // 2 < 1 << (j + 1):
            stop += 1
        half = 1 << j
        found: list[tuple[int, int]] = []
        for q0 in range(p, stop):
            q = np.int64(q0)
            node = 1 << (2 * q0 - 1).bit_length()
            middles = np.arange(0, n + 1, node)
            anchors = np.concatenate((middles, middles - q))
            anchors = anchors[(anchors >= 0) & (anchors + q <= n)]
            ahead = anchors[anchors + q < len(names)]
            back = anchors[(anchors >= half) & (anchors - half + q < len(names))]
            hits = np.concatenate((ahead[names[ahead] == names[ahead + q]], back[names[back - half] == names[back - half + q]]))
            if not len(hits):
                continue
            # Within a run of a period that divides q there is nothing new.
            at = np.minimum(hits, n - 1)
            known = (q % period[at] == 0) & (start[at] <= hits) & (hits + q <= end[at])
            found += [(q0, a) for a in np.unique(hits[~known]).tolist()]
        upto, last = -1, 0
        for q0, a in found:
            if q0 != last:
                upto, last = -1, q0
            if a <= upto:
                continue
            lo, hi = a - _reach(s, a, q0, -1), a + _reach(s, a, q0, 1)
            upto = hi
            if hi - lo + q0 >= max(least, power * q0):
                out.append((lo, hi - lo + q0, q0))
                start[lo : hi + q0], end[lo : hi + q0], period[lo : hi + q0] = lo, hi + q0, q0
        p = stop
    # A stretch that a divisor of its period has too is that one's run.
    best: dict[tuple[int, int], int] = {}
    for a, length, q in out:
        best[a, length] = min(q, best.get((a, length), q))
    return sorted((a, length, q) for (a, length), q in best.items())


def text_runs(words: np.ndarray, first: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """The runs of every text of a batch; ``words`` are numbers, equal for equal words, ``first`` each text's first."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(first) - 1)]
    keep = survivors(words, first, overlap())
    if not keep.any():
        return out
    at = np.flatnonzero(keep)
    doc = np.searchsorted(first, at, "right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (np.diff(doc) > 0)
    # Segments one after another, each ended by a number of its own.
    segment = np.cumsum(new) - 1
    string = np.empty(len(at) + int(segment[-1]) + 1, np.int64)
    place = np.arange(len(at)) + segment
    _, codes = np.unique(words[at], return_inverse=True)
    ends = np.ones(len(string), bool)
    ends[place] = False
    string[place] = codes
    string[ends] = -1 - np.arange(int(ends.sum()))
    sizes = np.bincount(segment)
    origin = np.zeros(len(string), np.int64)
    origin[place] = np.arange(len(at))
    for start, length, period in runs(string, int(sizes.max())):
        i = int(origin[start])
        out[doc[i]].append((int(at[i] - first[doc[i]]), length, period))
    return out


def collapsed(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: of each run only the first period."""
    drop = np.zeros(n + 1, np.int32)
    for start, length, period in found:
        drop[start + period] += 1
        drop[start + length] -= 1
    return np.cumsum(drop)[:n] == 0


def _words_of(batches, rewrite):
    """(ids, words of each text as bytes, numbers of the words, first word of each text) of batches of a bounded size.

    rewrite(doc_id, n): the places that a text's words are taken from, or None.
    """
    for batch in C.small_batches(batches):
        data, offsets = C.text_buffers(batch.column("text"))
        starts, ends, first = C.word_spans(data, offsets)
        numbers = C.span_hashes(data, starts, ends)
        raw, ids = data.tobytes(), batch.column("doc_id").to_pylist()
        texts = [raw[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        for i, doc_id in enumerate(ids) if rewrite else ():
            places = rewrite(doc_id, len(texts[i]))
            if places is not None:
                numbers[first[i] : first[i + 1]] = numbers[first[i] + places]
                texts[i] = [texts[i][k] for k in places.tolist()]
        yield ids, texts, numbers, first


FOUND = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def found_runs(docs: DataFrame, rewrite=None) -> DataFrame:
    """``FOUND`` of every row of docs (doc_id, text): its runs by start and period, and its words without what repeats in them, joined by one space."""

    @C.tidy
    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for ids, texts, numbers, first in _words_of(batches, rewrite):
            each = text_runs(numbers, first)
            out = [b" ".join([w for w, k in zip(t, collapsed(len(t), f).tolist(), strict=True) if k] if f else t).decode("utf-8", "replace") for t, f in zip(texts, each, strict=True)]
            rows = [[{"start": a, "length": n, "period": q} for a, n, q in f] for f in each]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(map(len, texts)), pa.int64()), pa.array(rows, kind), pa.array(out, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FOUND)


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Where the words of a text of n words come from under the query's contract; None where they stay."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % (1 + (n - a) // (3 + g % 8)))


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of ``FOUND``; start to period are the longest run's."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    # The order of structs: greatest length, then smallest start, then smallest period.
    top = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("l"), r.start.alias("s"), r.period.alias("p"))))
    rows = found.withColumn("_top", top)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_top.s").alias("start"),
        (-F.col("_top.l")).alias("length"),
        F.col("_top.p").alias("period"),
        F.floor(-F.col("_top.l") * 1000 / F.col("_top.p")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of every document's runs, its words repeated as the contract plants them; odd rows as the module says."""
    return digests(found_runs(C.table(spark, sf_dir, "documents", "doc_id", "text"), planted))
