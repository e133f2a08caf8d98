"""Exact removal of long byte strings that occur more than once, by suffix arrays of content-keyed shards.

A 400-byte string (window) is keyed by the least hash of its 100-byte strings.
Equal windows have equal keys, so every repeat lies within one key.  The starts
of a text that share a key in a row, with the bytes up to the end of the last
window, are a piece; all windows of a piece belong to its key:

1. Pieces get a 128-bit digest of their bytes.  Those of equal bytes are one
   content with a count and a place; sums by key say how many contents and bytes
   a key has.  All of this is partial aggregation, so a key that a third of all
   texts have is no task's own.  Keys of one content that occurs once are
   dropped, unless it has the key's string more than once: nothing in them
   repeats.  Of a key's only content that occurs more often, all windows repeat.
2. Different contents of one key meet in a shard.  The suffix array of
   the shard is built by induced sorting (``induced``), and permuted common
   prefixes tell which windows also start elsewhere.  A content that itself
   occurs more than once needs no comparison: all its windows repeat.
3. Verdicts go back to every text with the content; covered bytes are removed.

A key whose contents exceed ``shard_bytes`` (a passage that very many texts go on
from differently) is not put into one task: its windows are dealt by their own
128-bit digest instead.  Filters of a fixed size (1 MB) thin out texts and pieces
before they are joined; joins have stored tables on both sides, so that skewed
keys are split.

Texts are named by two 64-bit hashes of theirs and not by doc_id: what is removed
depends on the text alone.  So rows with equal, clashing or null ids are all
judged and all count.

Nulls are empty texts.  Texts below 400 bytes keep all bytes.  Very long texts
are cut like others, in batches of their own.  Repeated rows repeat each other
and come out as often as they came in, with all bytes of 400 and more removed.
An empty table gives no rows; further columns, whatever their names, are left
alone.  There are no ties: strings are judged on the input, and matches never
cross texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .induced import permuted_lcp, suffix_array
from .ngram_join import _runs, _whole_groups

GRAM = 100
SHARD_BYTES = 1 << 20
#: Pieces that a task holds to see which texts it has more than once.
HELD_PIECES = 200_000
CONTENT = ("h", "g", "g2", "n")
_PIECE = "ka long, kb long, at int, h long, g long, g2 long, n int, twice boolean, count long"


def _sliding(x: np.ndarray, width: int, least=np.minimum) -> np.ndarray:
    """The least (or, with np.maximum, largest) of every ``width`` values in a row."""
    span = 1
    while span * 2 <= width:
        x = least(x[:-span], x[span:])
        span *= 2
    return least(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def _twice(grams, key, start, n, width):
    """Whether a piece has its key's string more than once, so that windows within it could be equal."""
    held = np.concatenate((np.zeros(width - 1, key.dtype), key, np.zeros(width - 1, key.dtype)))
    chosen = np.flatnonzero(_sliding(held, width, np.maximum) == grams)  # strings that are the least of some window
    value = grams[chosen]
    out = n > width
    at = np.searchsorted(chosen, start)
    end = np.searchsorted(chosen, start + np.minimum(n, width) - 1 + width)
    live, count = np.flatnonzero(~out), np.zeros(len(start), np.int32)
    while len(live):
        live = live[at[live] < end[live]]
        count[live] += value[at[live]] == key[start[live]]
        at[live] += 1
    return out | (count > 1)


def _pieces(batch: pa.RecordBatch, length: int, gram: int):
    """(row, at, h, g, g2, n, twice): pieces of each text, their first start, key, digest, number of starts, and whether they could repeat themselves."""
    data, offsets = C.text_buffers(batch.column("text"))
    total = len(data)
    none = np.zeros(0, np.int64)
    if total < length:
        return (none,) * 6 + (none.astype(bool),)
    at = np.arange(total - gram + 1)
    grams = C.Rolling(data).of(at, at + gram)
    key = _sliding(grams, length - gram + 1)
    sizes = np.diff(offsets)
    rows = np.flatnonzero(sizes >= length)
    edge = np.zeros(total + 1, np.int32)
    np.add.at(edge, offsets[rows], 1)
    np.add.at(edge, offsets[rows + 1] - length + 1, -1)
    valid = np.cumsum(edge[: len(key)]) > 0
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    head[offsets[rows]] = True
    head[1:] |= ~valid[:-1]
    head &= valid
    start = np.flatnonzero(head)
    row = np.searchsorted(offsets, start, "right") - 1
    limit = np.minimum(np.append(start[1:], total), offsets[row + 1] - length + 1)
    n = limit - start
    g, g2 = C.digests(data, start, limit + length - 1)
    return row, start - offsets[row], key[start].view(np.int64), g, g2, n, _twice(grams, key, start, n, length - gram + 1)


def text_pieces(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """Pieces of all texts; a text that a task has seen of late only adds to the count."""

    def emit(held, counts):
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        index = columns.pop()
        count = np.array(counts, np.int64)[index]
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())
        arrays = [pa.array(x, t) for x, t in zip(columns, types, strict=True)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(count)], ["ka", "kb", "at", "h", "g", "g2", "n", "twice", "count"])

    @C.tidy
    def run(batches):
        held, size, seen, counts = [], 0, {}, []
        for batch in C.small_batches(batches):
            fresh = []
            for i, key in enumerate(zip(batch.column("ka").to_pylist(), batch.column("kb").to_pylist(), strict=True)):
                if key in seen:
                    counts[seen[key]] += 1
                else:
                    seen[key] = len(counts)
                    counts.append(1)
                    fresh.append(i)
            first = len(counts) - len(fresh)
            batch = batch.take(pa.array(fresh, pa.int64()))
            row, at, h, g, g2, n, twice = _pieces(batch, length, gram)
            if len(row):
                ka, kb = (batch.column(c).to_numpy()[row] for c in ("ka", "kb"))
                held.append((ka, kb, at, h, g, g2, n, twice, row + first))
                size += len(row)
            if size > HELD_PIECES:
                yield emit(held, counts)
                held, size, seen, counts = [], 0, {}, []
        if held:
            yield emit(held, counts)

    return texts.mapInArrow(run, _PIECE)


def contents(pieces: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """The contents of keys in which something may repeat: (h, g, g2, n, count, place, kind).

    kind: 0 the key's only content, which occurs more than once, 1 for a shard,
    2 too much for one.
    """
    often = pieces.groupBy("h").agg(F.sum("count").alias("c"), F.max("twice").alias("t")).where("c > 1 or t").select("h")
    some = C.thinned(pieces, "h", C.key_filter(often))
    each = C.stored(some.groupBy(*CONTENT).agg(F.sum("count").alias("count"), F.min(F.struct("ka", "kb", "at")).alias("place"), F.max("twice").alias("twice")))
    keys = each.groupBy("h").agg(F.sum("count").alias("total"), F.count("*").alias("different"), F.sum(F.col("n") + length).alias("room"), F.max("twice").alias("self"))
    keys = C.stored(keys.where("total > 1 or self"))
    kind = F.when((F.col("different") == 1) & (F.col("total") > 1), 0).when(F.col("room") <= shard_bytes, 1).otherwise(2)
    return each.join(keys, "h").select(*CONTENT, "count", "place", kind.alias("kind"))


def _with_bytes(texts: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """The contents with their bytes, cut from the text of their place."""

    @C.tidy
    def cut(batches):
        for batch in C.small_batches(batches):
            data, offsets = C.text_buffers(batch.column("text"))
            own = batch.column("own")
            rows = np.repeat(np.arange(batch.num_rows), np.diff(own.offsets.to_numpy()))
            flat = own.flatten()
            *columns, at = (flat.field(i) for i in range(6))
            start = offsets[rows] + at.to_numpy()
            end = start + columns[3].to_numpy() + length - 1
            raw = data.tobytes()
            step = 2000
            for k in range(0, len(start), step):
                part = slice(k, k + step)
                blobs = pa.array([raw[a:b] for a, b in zip(start[part].tolist(), end[part].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(x.slice(k, step) for x in columns), blobs], [*CONTENT, "count", "bytes"])

    own = found.groupBy("place.ka", "place.kb").agg(F.collect_list(F.struct(*CONTENT, "count", F.col("place.at"))).alias("own"))
    own = C.stored(own)
    picked = C.one_each(C.thinned(texts, "ka", C.key_filter(own.select("ka"))))
    return picked.join(own, ["ka", "kb"]).select("text", "own").mapInArrow(cut, "h long, g long, g2 long, n int, count long, bytes binary")


def shard_repeats(texts: list[bytes], starts: list[int], length: int) -> list[np.ndarray]:
    """Which of the first ``starts[i]`` windows of each text also start elsewhere in these texts."""
    joined = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)  # UTF-8 has no byte 255
    sa = suffix_array(joined)
    plcp, phi = permuted_lcp(joined, sa)
    offset = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    room = np.zeros(len(joined) + 1, np.int32)
    np.add.at(room, offset[:-1], 1)
    np.add.at(room, offset[:-1] + np.array(starts), -1)
    valid = np.cumsum(room[:-1]) > 0
    hit = np.flatnonzero(valid & (plcp >= length))
    flag = np.zeros(len(joined), bool)
    flag[hit] = True
    flag[phi[hit]] = True
    flag &= valid
    return [flag[o : o + n] for o, n in zip(offset[:-1].tolist(), starts, strict=True)]


def _ranges(flag: np.ndarray) -> list[int]:
    step = np.flatnonzero(np.diff(np.concatenate(([0], flag.astype(np.int8), [0]))))
    return step.tolist()


def shard_verdicts(found: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """(h, g, g2, n, ranges) from contents with bytes: first and last + 1 start of each run of repeated windows."""

    def solve(rows):
        texts = [x.as_py() for x in rows.column("bytes").combine_chunks()]
        n = rows.column("n").to_pylist()
        flags = shard_repeats(texts, n, length)
        out = [[0, k] if c > 1 else _ranges(f) for f, k, c in zip(flags, n, rows.column("count").to_pylist(), strict=True)]
        batch = rows.select(CONTENT).combine_chunks().to_batches()[0]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], [*CONTENT, "ranges"])

    @C.tidy
    def run(batches):
        held, size = [], 0
        for t in _whole_groups(batches, "h"):
            for group in [t.slice(int(a), int(k)) for a, k in zip(*_runs(t.column("h").to_numpy()), strict=True)]:
                own = sum(group.column("n").to_pylist()) + (length + 1) * group.num_rows
                if held and size + own > shard_bytes:
                    yield solve(pa.concat_tables(held))
                    held, size = [], 0
                held.append(group)
                size += own
        if held:
            yield solve(pa.concat_tables(held))

    return found.repartition("h").sortWithinPartitions("h").mapInArrow(run, "h long, g long, g2 long, n int, ranges array<int>")


def window_verdicts(found: DataFrame, length: int) -> DataFrame:
    """The same for keys too large for one shard: windows are dealt by their own digest.

    Digests are counted by task before they are dealt.  Where each piece has
    those that occur more than once is found in a second pass, thinned by a
    filter, so that rows are not made for windows that occur once.
    """

    def windows(batches):
        for batch in batches:
            data, offsets = C.text_buffers(batch.column("bytes"))
            n = batch.column("n").to_numpy()
            for i in range(batch.num_rows):
                for a in range(0, int(n[i]), C.CHUNK_BYTES):
                    s = np.arange(a, min(a + C.CHUNK_BYTES, int(n[i])))
                    yield batch.slice(i, 1), s, *C.digests(data, offsets[i] + s, offsets[i] + s + length)

    @C.tidy
    def counted(batches):
        held, size = [], 0

        def out():
            w, w2, c = map(np.concatenate, zip(*held, strict=True))
            order = np.lexsort((w2, w))
            w, w2, c = w[order], w2[order], c[order]
            head = np.flatnonzero(np.concatenate(([True], (w[1:] != w[:-1]) | (w2[1:] != w2[:-1]))))
            return w[head], w2[head], np.add.reduceat(c, head)

        for piece, s, w, w2 in windows(batches):
            held.append((w, w2, np.full(len(s), piece.column("count")[0].as_py())))
            size += len(s)
            if size > HELD_PIECES:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out()], ["w", "w2", "c"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out()], ["w", "w2", "c"])

    often = C.stored(found.mapInArrow(counted, "w long, w2 long, c long").groupBy("w", "w2").agg(F.sum("c").alias("c")).where("c > 1").select("w", "w2"))
    sent = found.sparkSession.sparkContext.broadcast(C.key_filter(often.select("w")))

    @C.tidy
    def likely(batches):
        for piece, s, w, w2 in windows(batches):
            ok = C.may_have(sent.value, w)
            same = [pa.array(np.full(int(ok.sum()), piece.column(c)[0].as_py()), t) for c, t in (("h", pa.int64()), ("g", pa.int64()), ("g2", pa.int64()), ("n", pa.int32()))]
            yield pa.RecordBatch.from_arrays([*same, pa.array(s[ok].astype(np.int32)), pa.array(w[ok]), pa.array(w2[ok])], [*CONTENT, "s", "w", "w2"])

    hits = found.mapInArrow(likely, "h long, g long, g2 long, n int, s int, w long, w2 long").join(often, ["w", "w2"])
    each = F.flatten(F.transform(F.array_sort(F.collect_list("s")), lambda s: F.array(s, s + 1)))
    return hits.groupBy(*CONTENT).agg(each.alias("ranges"))


def verdicts(texts: DataFrame, pieces: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """(h, g, g2, n, ranges) of every content with windows that occur more than once; pieces are stored."""
    found = C.stored(contents(pieces, length, shard_bytes))
    whole = found.where("kind = 0").select(*CONTENT, F.array(F.lit(0), F.col("n")).alias("ranges"))
    parts = whole.union(shard_verdicts(_with_bytes(texts, found.where("kind = 1"), length), length, shard_bytes))
    large = found.where("kind = 2")
    if large.take(1):
        parts = parts.union(window_verdicts(C.stored(_with_bytes(texts, large, length)), length))
    return C.stored(parts.where("size(ranges) > 0"))


def removed_ranges(docs: DataFrame, length: int = 400, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(ka, kb, ranges) of every different text with something to remove: flat list of first and last + 1 byte of the ranges, which can overlap."""
    texts = C.keyed(docs)
    pieces = C.stored(text_pieces(texts, length, gram))
    known = verdicts(texts, pieces, length, shard_bytes)
    places = C.thinned(pieces.select("ka", "kb", "at", *CONTENT), "h", C.key_filter(known.select("h"))).distinct()
    # Odd places hold ends: a start that repeats covers length bytes.
    absolute = F.transform("ranges", lambda x, i: x + F.col("at") + F.when(i % 2 == 1, length - 1).otherwise(0))
    rows = C.stored(places).join(known, list(CONTENT)).select("ka", "kb", absolute.alias("ranges"))
    return rows.groupBy("ka", "kb").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def spans(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs (first, last + 1) of ranges that can overlap or touch."""
    a, b = flat[0::2], flat[1::2]
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    first = np.flatnonzero(new)
    return a[first], b[np.append(first[1:], len(a)) - 1] if len(a) else b


def _apply(docs: DataFrame, length: int, gram: int, shard_bytes: int, schema, columns) -> DataFrame:
    """``columns(rows, spans of each row)`` of every row; texts that surely have nothing to remove are not shuffled."""
    ranges = C.stored(removed_ranges(docs.select("text"), length, gram, shard_bytes))
    table = C.key_filter(ranges.select("ka"))
    # The row goes in one struct, so that no name of its columns can clash.
    rows = docs.select(*C.text_key(), F.struct(*docs.columns).alias("row"))

    @C.tidy
    def run(batches):
        for batch in C.small_rows(batches):
            own = pa.RecordBatch.from_struct_array(batch.column("row"))
            lists = batch.column("ranges") if "ranges" in batch.schema.names else None
            got = [spans(lists[i].values.to_numpy() if lists is not None and lists[i].is_valid else np.zeros(0, np.int32)) for i in range(batch.num_rows)]
            yield columns(own, got)

    hit = C.thinned(rows, "ka", table).join(ranges, ["ka", "kb"], "left").select("row", "ranges")
    rest = C.thinned(rows, "ka", table, False).select("row")
    return hit.mapInArrow(run, schema).union(rest.mapInArrow(run, schema))


def _left(raw: bytes, first, last) -> bytes:
    out, at = [], 0
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def report(docs: DataFrame, length: int = 400, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, repeats) of every text; repeats: whether anything is removed."""

    def columns(batch, got):
        data, offsets = C.text_buffers(batch.column("text"))
        raw = data.tobytes()
        rows = []
        for i, (a, b) in enumerate(got):
            own = raw[offsets[i] : offsets[i + 1]]
            rows.append((len(own), int((b - a).sum()), len(a), hashlib.sha256(_left(own, a, b)).hexdigest()))
        n_bytes, n_removed, n_spans, digest = zip(*rows, strict=True)
        columns = [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest), pa.array([n > 0 for n in n_removed], pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "repeats"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _apply(docs, length, gram, shard_bytes, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, repeats boolean", columns)


def cleaned(docs: DataFrame, length: int = 400, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` without the repeated bytes.  The rest of a character that a cut has split goes too."""

    names = docs.columns

    def columns(batch, got):
        data, offsets = C.text_buffers(batch.column("text"))
        raw = data.tobytes()
        known = batch.column("text").is_valid().to_pylist()
        texts = [_left(raw[offsets[i] : offsets[i + 1]], a, b).decode("utf-8", "ignore") if known[i] else None for i, (a, b) in enumerate(got)]
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names], names)

    return _apply(docs, length, gram, shard_bytes, docs.schema, columns)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What 400-byte repeats take from every document; odd rows as the module says."""
    return report(C.table(spark, sf_dir, "documents", "doc_id", "text"))


#: The same for DuckDB, which compares all windows by their MD5.
SQL = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS MATERIALIZED (SELECT r, i, md5(array_slice(b, i, i + 399)) AS m FROM d, unnest(range(1, octet_length(b) - 398)) AS x(i) WHERE octet_length(b) >= 400),
hit AS (SELECT r, i FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)),
steps AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 400 THEN 0 ELSE 1 END AS new FROM hit),
named AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM steps),
runs AS MATERIALIZED (SELECT r, min(i) AS a, max(i) + 399 AS z FROM named GROUP BY r, k),
sums AS (SELECT r, sum(z - a + 1) AS n_removed, count(*) AS n_spans FROM runs GROUP BY r),
rest AS (SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) + 1 AS a, a - 1 AS z FROM runs UNION ALL SELECT r, max(z) + 1, 1000000000 FROM runs GROUP BY r),
kept AS (SELECT d.r, string_agg(CASE WHEN rest.z < rest.a THEN '' ELSE hex(array_slice(b, rest.a, least(rest.z, octet_length(b)))) END, '' ORDER BY rest.a) AS h FROM d JOIN rest ON rest.r = d.r GROUP BY d.r)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  CASE WHEN h IS NULL THEN sha256(b) ELSE sha256(unhex(h)) END AS kept_sha256, n_removed IS NOT NULL AS repeats
FROM d LEFT JOIN sums ON sums.r = d.r LEFT JOIN kept ON kept.r = d.r
"""
