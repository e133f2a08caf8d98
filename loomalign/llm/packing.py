"""Best-fit packing of tokenized documents into sequences under several capacities.

Every document is its ids and a closing id 0; longer ones are cut, the first
piece taking the remainder.  Pieces carry a demand vector (tokens, one document,
attention cost = tokens squared) and go, longest first, into the open sequence
with the least weighted norm of what stays free; if none has room in every
dimension, a new one opens.  Open sequences lie in buckets by free tokens and
number of documents, searched from the tightest until the token term alone
exceeds the best norm, so the choice is the exact minimum over the buckets.

Shards (by hash of piece, of about 5,000 pieces each) are packed on their own.  At most one sequence of a shard can be half empty or more: these, one for
each shard, are packed once more, those of 1,024 shards together.

Only small rows (no ids) are shuffled.  A null text is empty, and an empty text
is one piece, the closing id.  Very long texts are encoded whole and cut into
full sequences.  Repeated rows, also those without doc_id, are packed as often
as they come; nothing tells the pieces of equal ids apart but their sequence.
Ties: equal lengths are taken by doc_id and piece, and of bins of equal norm the
tightest found first.  An empty table gives no rows.  Further columns are not
read by the query; ``packed`` passes them on.
"""

from __future__ import annotations

import base64
import heapq
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

LENGTH = 2048
END_ID = 0
#: Pieces that one group packs, on average.
SHARD_PIECES = 5000
#: Weights of free tokens, documents and attention cost in the norm.
WEIGHTS = (1.0, 0.002, 0.02)
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"

_ENCODERS: dict = {}


def encoder(json_path: str, ranks_path: str | None):
    """ids of a text as the tokenizer file gives them.

    With the ranks of the same vocabulary, ordinary text takes a faster
    library that gives the same ids; texts that hold a special token's string
    always go through the tokenizer itself.
    """
    key = (json_path, ranks_path)
    if key not in _ENCODERS:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(json_path)
        special = [t.content for t in whole.get_added_tokens_decoder().values()]
        slow = lambda text: np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)
        if ranks_path is None:
            _ENCODERS[key] = slow
        else:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            plain = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            _ENCODERS[key] = lambda text: slow(text) if any(s in text for s in special) else np.array(plain.encode_ordinary(text), np.uint32)
    return _ENCODERS[key]


def cuts(total: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``total`` ids: only the first may be shorter."""
    first = total % length or length
    return [(0, first), *((a, length) for a in range(first, total, length))] if total > length else [(0, total)]


def pieces(docs: DataFrame, json_path: str, ranks_path: str | None, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """The pieces of every document, with their ids if asked for."""

    @C.tidy
    def run(batches):
        encode = encoder(json_path, ranks_path)
        for batch in C.small_batches(batches):
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(END_ID)).astype("<u4")
                for k, (a, n) in enumerate(cuts(len(ids), length)):
                    part = ids[a : a + n]
                    out.append((doc, k, a, n, zlib.crc32(part.tobytes()), part))
            columns = list(zip(*out, strict=True))
            arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:5])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array([p.astype(np.int32) for p in columns[5]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECE + ", ids array<int>" * with_ids)


def best_fit(lengths: list[int], counts: list[int], costs: list[int], caps: tuple[int, int, int], weights=WEIGHTS) -> list[int]:
    """The bin of each item, taken in the given order (longest first for the known bound)."""
    cap, max_docs, max_cost = caps
    w0, w1, w2 = weights
    buckets: list[dict[int, list]] = [{} for _ in range(cap + 1)]
    present = 0  # bit r: some open bin has r free tokens
    used: list[tuple[int, int, int]] = []
    where = []
    for n, docs, cost in zip(lengths, counts, costs, strict=True):
        best, choice = None, None
        rest = present >> n
        while rest:
            low = (rest & -rest).bit_length() - 1
            free = n + low
            term = w0 * ((free - n) / cap) ** 2
            if best is not None and term >= best:
                break
            for held, heap in buckets[free].items():
                left = max_docs - held - docs
                if left < 0:
                    continue
                # The heap's first has spent most on attention; where that leaves no room, the fullest that fits.
                spent = -heap[0][0]
                entry = heap[0]
                if spent + cost > max_cost:
                    fits = [e for e in heap if -e[0] + cost <= max_cost]
                    if not fits:
                        continue
                    entry = min(fits)
                    spent = -entry[0]
                value = term + w1 * (left / max_docs) ** 2 + w2 * ((max_cost - spent - cost) / max_cost) ** 2
                if best is None or value < best:
                    best, choice = value, (free, held, entry)
            rest &= rest - 1
            rest = rest >> (low + 1) << (low + 1)
        if choice is None:
            at, free, held, spent = len(used), cap, 0, 0
            used.append((0, 0, 0))
        else:
            free, held, entry = choice
            heap = buckets[free][held]
            if entry is heap[0]:
                heapq.heappop(heap)
            else:
                heap.remove(entry)
                heapq.heapify(heap)
            if not heap:
                del buckets[free][held]
                if not buckets[free]:
                    present &= ~(1 << free)
            spent, at = -entry[0], entry[1]
        free, held, spent = free - n, held + docs, spent + cost
        if free > 0:
            heapq.heappush(buckets[free].setdefault(held, []), (-spent, at))
            present |= 1 << free
        where.append(at)
    return where


def packed(parts: DataFrame, length: int = LENGTH, max_docs: int | None = None, max_cost: int | None = None, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``parts`` (with doc_id, piece, length and any more) with sequence_id and offset.

    max_docs and max_cost default to what a full sequence can hold, and then do not bind.
    """
    caps = (length, max_docs or length, max_cost or length * length)
    parts = C.stored(parts)
    shards = max(1, -(-parts.count() // shard_pieces))
    columns = parts.columns
    schema = parts.schema.add("sequence_id", "long").add("offset", "long")

    def pack(key, group):
        shard = key[0].as_py()
        group = group.select(columns)
        size, doc, piece = (pc.fill_null(group.column(c), -1).to_numpy() for c in ("length", "doc_id", "piece"))
        order = np.lexsort((piece, doc, -size))
        group, size = group.take(pa.array(order)), size[order]
        at = np.array(best_fit(size.tolist(), [1] * len(size), (size * size).tolist(), caps), np.int64)
        by = np.argsort(at, kind="stable")
        sums = np.concatenate(([0], np.cumsum(size[by])))[:-1]
        head = np.concatenate(([True], at[by][1:] != at[by][:-1]))
        offset = np.empty(len(size), np.int64)
        offset[by] = sums - np.maximum.accumulate(np.where(head, sums, 0))
        return group.append_column("sequence_id", pa.array(at + (shard << 32))).append_column("offset", pa.array(offset))

    # Rows of one doc_id differ in what they hold; rows without one are dealt by their places in the stored parts.
    named = [c for c in ("doc_id", "piece", "length", "start", "ids_crc32") if c in columns]
    place = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    dealt = parts.withColumn("shard", F.pmod(F.xxhash64(*named, place), F.lit(shards)))
    alone = C.stored(dealt.groupBy("shard").applyInArrow(pack, schema))
    # At most one sequence of a shard is half empty: a row each, and 1,024 shards' rows are packed together.
    fill = alone.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), F.count("*").alias("docs"), F.sum(F.col("length") * F.col("length")).alias("cost"))
    small = fill.where(F.col("tokens") * 2 <= length).groupBy(F.shiftright("sequence_id", 32).alias("shard")).agg(F.min_by(F.struct("sequence_id", "tokens", "docs", "cost"), F.struct("tokens", "sequence_id")).alias("s"))

    def again(key, group):
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("tokens", "sequence_id", "docs", "cost")), strict=True), key=lambda r: (-r[0], r[1]))
        at = best_fit([r[0] for r in rows], [r[2] for r in rows], [r[3] for r in rows], caps)
        into, shift, moves = {}, {}, []
        for (tokens, name, _, _), b in zip(rows, at, strict=True):
            moves.append((name, into.setdefault(b, name), shift.get(b, 0)))
            shift[b] = shift.get(b, 0) + tokens
        return pa.table(dict(zip(("sequence_id", "into", "shift"), (pa.array(c, pa.int64()) for c in zip(*moves, strict=True)), strict=True)))

    moved = small.select("s.*", F.shiftright("shard", 10).alias("block")).groupBy("block").applyInArrow(again, "sequence_id long, into long, shift long")
    out = alone.join(moved, "sequence_id", "left")
    return out.select(*columns, F.coalesce("into", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))


def sequences(parts: DataFrame) -> DataFrame:
    """(sequence_id, ids) of packed pieces that carry their ids: at most one sequence's ids in a group."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def packed_documents(docs: DataFrame) -> DataFrame:
    return packed(pieces(docs, *vocabulary()))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place; odd rows as the module says."""
    return packed_documents(C.table(spark, sf_dir, "documents", "doc_id", "text"))
