"""Near-duplicate documents by the Jaccard similarity of word n-grams: a rare-first prefix-filter join.

``near_duplicates`` returns one row per document with its component; links are
found as follows.

1. A table counts in how many documents shingles of each cell occur; the
   logarithm of that count and the hash make one 64-bit token whose order is
   rare first.  The table grows with the corpus, up to 2^24 cells of one byte,
   which bounds what is broadcast.  Any order gives the same links.
2. Documents of equal sets are one node (they link by themselves).
3. A set of size n shares one of its first n - ceil(0.8 n) + 1 tokens with any
   set that it links with.  How many nodes have each of these tokens is counted
   by partial aggregation; tokens of one node are dropped before anything is
   dealt by token.
4. Within a token, pairs pass the length and the positional filter.  A first
   round takes each node with the next one of the token only (of the token and
   a part, where it has more than ``PART`` nodes); components of the links found
   so far are formed; a second round takes what is left between *different*
   components, so that no link between components is lost.
5. Tokens of up to ``few`` nodes give pairs.  The nodes of longer lists never
   meet as a whole: each list is cut into tiles of up to about ``tile`` nodes,
   two tiles are compared in one task, and it returns a spanning forest of their
   links and not the pairs.  What prefixes share bounds the intersection before
   any whole set is fetched.
6. A pair is verified once: a suffix filter (counts of tokens in classes bound
   the overlap) and then the exact intersection.  The second round leaves out
   what the first has verified, pairs of short lists are left to the tiles where
   they also share a long list, and a pair belongs to the least long list that
   has both.

Nulls, empty texts and texts without words have an empty set: n_shingles 0, a
component of their own.  Rows without doc_id link with nothing and have no
component.  Texts with fewer words than n are one shingle; very long texts are
taken whole, in batches of their own.  Repeated rows are one node and come out
as often as they came in; rows of one doc_id with different texts are nodes of
their own, with the least doc_id that each reaches.  There are no ties: a
component's name is its least doc_id.  An empty table gives no rows.  Further
columns, whatever their names, are not read.

Words and sets are compared by 64-bit hashes (of words over 64 bytes, BLAKE2b);
sets are equal if size and two sums of 64 bits are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Bits of the number of cells: the least and the most; bytes of text to a cell between them.
SKETCH_BITS = (20, 24)
CELL_BYTES = 512
#: Classes of the suffix filter for sets of up to CLASS_SIZES[0]; four times as many beyond each size.
CLASSES = 256
CLASS_SIZES = (1024, 4096, 16384)
#: Nodes of a token that meet in the first round.
PART = 1024
#: Tokens of a tile, on average: 32 MB.
TILE_TOKENS = 1 << 22


def _shingles(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, one after another, and where each text's begin."""
    data, offsets = C.text_buffers(batch.column("text"))
    data = C.lower_ascii(data)
    starts, ends, first = C.word_spans(data, offsets)
    hashes, at = C.windows(C.span_hashes(data, starts, ends), first, width)
    parts = [np.unique(hashes[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    sizes = np.array([len(p) for p in parts], np.int64)
    return np.concatenate(parts) if parts else hashes[:0], np.concatenate(([0], np.cumsum(sizes)))


def frequency_levels(docs: DataFrame, width: int) -> np.ndarray:
    """log2 of the number of documents by cell of the hash: one byte a cell, more cells for more text."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max(int(size // CELL_BYTES).bit_length(), SKETCH_BITS[0]), SKETCH_BITS[1])

    def cells(batch):
        cell = [np.zeros(0, np.int64)]
        for part in C.small_batches([batch]):
            cell.append((_shingles(part, width)[0] >> np.uint64(64 - bits)).astype(np.int64))
        return np.concatenate(cell)

    return C.summed_table(docs.select("text"), cells, 1 << bits, finish=lambda sums: np.minimum(np.log2(sums.astype(np.float64) + 1), 31).astype(np.uint8))


def _tokens(batch, width, levels):
    """As _shingles, but of tokens in rare-first order (as unsigned numbers below 2^63)."""
    hashes, at = _shingles(batch, width)
    level = levels[(hashes >> np.uint64(65 - len(levels).bit_length())).astype(np.int64)].astype(np.uint64)
    tokens = (level << np.uint64(58)) | (hashes >> np.uint64(6))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        tokens[a:b].sort()
    return tokens, at


def _needed(n: np.ndarray, percent: int) -> np.ndarray:
    """The least size of an intersection with a set that links."""
    return -(-n * percent // 100)


def _class_counts(tokens: np.ndarray, n: np.ndarray) -> list[bytes]:
    """How many tokens of each set fall in each class, one byte a class; larger sets have more classes."""
    out = [b""] * len(n)
    doc = np.repeat(np.arange(len(n)), n)
    level = np.searchsorted(CLASS_SIZES, n, "left")
    for k in np.unique(level):
        width = CLASSES << (2 * int(k))
        rows = np.flatnonzero(level == k)
        use = np.isin(doc, rows) if len(rows) < len(n) else slice(None)
        at = np.searchsorted(rows, doc[use]) * width + (tokens[use] % np.uint64(width)).astype(np.int64)
        counts = np.minimum(np.bincount(at, minlength=len(rows) * width), 255).astype(np.uint8).reshape(-1, width)
        for r, c in zip(rows.tolist(), counts, strict=True):
            out[r] = c.tobytes()
    return out


def _most_shared(x: pa.Array, y: pa.Array) -> np.ndarray:
    """An upper bound of the intersections of pairs of sets, from their counts by class."""
    out = np.zeros(len(x), np.int64)
    (xd, xo), (yd, yo) = C.text_buffers(x), C.text_buffers(y)
    kinds = np.stack((np.diff(xo), np.diff(yo)), 1)
    for a, b in np.unique(kinds, axis=0).tolist():
        rows = np.flatnonzero((kinds == (a, b)).all(1))
        if not a or not b:
            continue
        p, q = xd[xo[rows, None] + np.arange(a)], yd[yo[rows, None] + np.arange(b)]
        # A count of 255 stands for any larger one: it bounds nothing.
        wild = ((p == 255).any(1)) & ((q == 255).any(1))
        width = min(a, b)
        p, q = (z.reshape(len(rows), -1, width).sum(1, dtype=np.int32) for z in (p, q))
        out[rows] = np.where(wild, np.iinfo(np.int64).max, np.minimum(p, q).sum(1))
    return out


def sketches(docs: DataFrame, width: int, percent: int, levels) -> DataFrame:
    """(doc_id, ka, kb, n, digest_a, digest_b, prefix, classes): key of the text, size and digests of the set, its first tokens, counts by class."""
    sent = docs.sparkSession.sparkContext.broadcast(levels)

    @C.tidy
    def run(batches):
        for batch in C.small_batches(batches):
            tokens, at = _tokens(batch, width, sent.value)
            n = np.diff(at)
            sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(C.mixed(tokens ^ np.uint64(salt))))) for salt in (0x51, 0xA3D7)]
            digests = [C.mixed((s[at[1:]] - s[at[:-1]]) ^ n.astype(np.uint64)) for s in sums]
            k = np.where(n > 0, n - _needed(n, percent) + 1, 0)
            ends = np.cumsum(k)
            take = np.repeat(at[:-1] - (ends - k), k) + np.arange(int(ends[-1]))
            classes = _class_counts(tokens, n)
            columns = [batch.column("doc_id"), batch.column("ka"), batch.column("kb"), pa.array(n), *map(C.signed, digests), C.lists(C.signed(tokens[take]), np.concatenate(([0], ends))), pa.array(classes, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ka", "kb", "n", "digest_a", "digest_b", "prefix", "classes"])

    schema = "doc_id long, ka long, kb long, n long, digest_a long, digest_b long, prefix array<long>, classes binary"
    return docs.select("doc_id", *C.text_key(), "text").mapInArrow(run, schema)


def different_sets(sets: DataFrame) -> DataFrame:
    """(node, digest_a, digest_b, n, ka, kb, prefix, classes): every set that is not empty once, with a text that has it."""
    one = F.struct("doc_id", "ka", "kb")
    each = sets.where("n > 0").groupBy("digest_a", "digest_b", "n").agg(F.min(one).alias("one"), F.min_by("prefix", one).alias("prefix"), F.min_by("classes", one).alias("classes"))
    # The numbers are fixed by being written.
    return C.stored(each.select(F.monotonically_increasing_id().alias("node"), "digest_a", "digest_b", "n", "one.ka", "one.kb", "prefix", "classes"))


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return head, np.diff(np.append(head, len(keys)))


def _whole_groups(batches, key: str):
    """Tables of whole groups from batches sorted by ``key``, whose groups have a bounded size."""
    held = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = batch.column(key).to_numpy()
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def shared_postings(nodes: DataFrame) -> DataFrame:
    """(token, size, node, n, pos) of prefix tokens that two nodes or more have; size: how many.

    Sizes come from partial aggregation; nodes and sizes are joined as stored
    tables, so that a token of very many nodes is split between tasks.
    """
    sizes = C.stored(nodes.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("size")).where("size > 1"))
    sent = nodes.sparkSession.sparkContext.broadcast(C.key_filter(sizes.select("token")))

    @C.tidy
    def likely(batches):
        for batch in batches:
            prefix = batch.column("prefix")
            token, at = prefix.flatten().to_numpy(), prefix.offsets.to_numpy()
            count = np.diff(at)
            row = np.repeat(np.arange(batch.num_rows), count)
            pos = np.arange(len(token)) - (at[:-1] - at[0])[row]
            ok = C.may_have(sent.value, token)
            columns = [pa.array(token[ok]), *(batch.column(c).take(pa.array(row[ok])) for c in ("node", "n")), pa.array(pos[ok].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["token", "node", "n", "pos"])

    rows = nodes.select("node", F.col("n").cast("int").alias("n"), "prefix").mapInArrow(likely, "token long, node long, n int, pos int")
    return C.stored(rows.join(sizes, "token").select("token", "size", "node", "n", "pos"))


def _passes(n1, n2, p1, p2, percent):
    """Length and positional filter."""
    low, high = np.minimum(n1, n2), np.maximum(n1, n2)
    need = -(-percent * (n1 + n2) // (100 + percent))
    return (100 * low >= percent * high) & (1 + np.minimum(n1 - p1 - 1, n2 - p2 - 1) >= need)


def chained_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a < b): each node with the next one, in order of size, of its token and part of it."""

    @C.tidy
    def run(batches):
        carry = None
        for batch in batches:
            t = batch if carry is None else pa.Table.from_batches([carry, batch]).combine_chunks().to_batches()[0]
            token, part, node, n, pos = (t.column(c).to_numpy().astype(np.int64) for c in ("token", "part", "node", "n", "pos"))
            i = np.flatnonzero((token[1:] == token[:-1]) & (part[1:] == part[:-1]))
            i = i[_passes(n[i], n[i + 1], pos[i], pos[i + 1], percent)]
            got = np.unique(np.stack((np.minimum(node[i], node[i + 1]), np.maximum(node[i], node[i + 1]))), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1])], ["a", "b"])
            if t.num_rows:
                carry = t.slice(t.num_rows - 1)

    parts = F.ceil(F.col("size") / PART)
    rows = postings.withColumn("part", F.pmod(F.xxhash64("node", "token"), parts))
    rows = rows.select("token", "part", "n", "node", "pos")
    return rows.repartition("token", "part").sortWithinPartitions("token", "part", "n", "node").mapInArrow(run, "a long, b long").distinct()


def _length_class(percent: int) -> Column:
    """Sizes of sets that link are in the same class or in adjacent ones."""
    return F.floor(F.ln(F.col("n")) / F.ln(F.lit(100.0 / percent)))


def open_postings(postings: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """(token, size, node, n, comp) that may still have a partner in another component, by token and length class."""
    marked = postings.join(comps.withColumnRenamed("id", "node"), "node", "left").withColumn("comp", F.coalesce("component_id", "node")).drop("component_id", "pos")
    marked = C.stored(marked.withColumn("class", _length_class(percent) if percent < 100 else F.col("n").cast("long")))
    ends = marked.groupBy("token", "class").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    reach = F.explode(F.array(*(F.col("class") + k for k in (-1, 0, 1)))).alias("class")
    near = ends.select("token", reach, "low", "high").groupBy("token", "class").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return C.stored(marked.join(C.stored(near.where("low < high").select("token", "class")), ["token", "class"]).drop("class"))


def few_pairs(short: DataFrame, percent: int) -> DataFrame:
    """(a, b, shared) between components, of tokens of few nodes; shared: tokens of the batch that have both."""

    @C.tidy
    def run(batches):
        for t in _whole_groups(batches, "token"):
            token, node, n, comp = (t.column(c).to_numpy().astype(np.int64) for c in ("token", "node", "n", "comp"))
            head, size = _runs(token)
            end = np.repeat(head + size, size)
            live, found, step = np.arange(len(token)), [], 1
            while len(live):  # partners by distance: sizes rise, so a row is done at the first that is too large
                live = live[live + step < end[live]]
                live = live[100 * n[live] >= percent * n[live + step]]
                i = live[comp[live] != comp[live + step]]
                found.append(np.stack((np.minimum(node[i], node[i + step]), np.maximum(node[i], node[i + step]))))
                step += 1
            pairs, shared = np.unique(np.concatenate(found, axis=1), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(shared)], ["a", "b", "shared"])

    rows = short.select("token", "n", "node", "comp").repartition("token").sortWithinPartitions("token", "n", "node")
    pairs = rows.mapInArrow(run, "a long, b long, shared long")
    return pairs.groupBy("a", "b").agg(F.sum("shared").alias("shared"))


def by_prefix(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """The pairs that their prefixes still allow, but for those that share a long list: these are the tiles'.

    All tokens of the prefix that ends first lie before the other's end, so
    those that the prefixes do not share are in no intersection.
    """
    facts = facts.withColumn("rest", F.ceil(F.col("n") * percent / 100) - 1)

    def side(end):
        return facts.select(F.col("node").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in ("n", "last", "own", "rest")))

    pairs = pairs.join(side("a"), "a").join(side("b"), "b")
    rest = F.when(F.col("last_a") <= F.col("last_b"), F.col("rest_a")).otherwise(F.col("rest_b"))
    enough = (F.col("shared") + rest) * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b"))
    apart = ~F.coalesce(F.arrays_overlap("own_a", "own_b"), F.lit(False))
    return pairs.where(enough & apart).select("a", "b")


def tile_links(members: DataFrame, facts: DataFrame, tried: DataFrame, docs: DataFrame, width: int, percent: int, levels, tile: int, every: bool = False) -> DataFrame:
    """Links (a, b) of a spanning forest between components, of nodes in long lists (node, token, n, comp).

    A list's nodes are dealt to tiles by hash, and its pairs of tiles are
    tasks.  A pair of nodes belongs to the least token whose long list has
    both; a first pass, over the lists' tokens alone, finds which nodes a
    task needs, and only their whole sets go there.  Pairs in ``tried`` are not
    compared again.  every: all compared pairs instead of the forest.
    """
    many = F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum("n") / TILE_TOKENS))
    sizes = C.stored(members.groupBy("token").agg(many.cast("int").alias("tiles")))
    partners = tried.select(F.col("a").alias("node"), "b").union(tried.select("b", "a")).groupBy("node").agg(F.collect_list("b").alias("tried"))
    own = facts.where("own is not null").join(partners, "node", "left").select("node", "own", "last", "other", F.coalesce("tried", F.array().cast("array<long>")).alias("tried"))
    own = C.stored(own)
    rows = members.join(sizes, "token").join(own, "node")
    rows = rows.withColumn("t", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("token", F.least("t", "o").alias("p"), F.greatest("t", "o").alias("q"), "t", "node", "comp", "n", "own", "last", "other", "tried")

    def flat(column):
        column = column.combine_chunks()
        return column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()

    def could(group, left, right):
        """Which pairs are of different components, fit in length and have not been tried."""
        node, comp, n = (group.column(c).to_numpy() for c in ("node", "comp", "n"))
        low, high = np.minimum(n[left, None], n[None, right]), np.maximum(n[left, None], n[None, right])
        out = (comp[left, None] != comp[None, right]) & (100 * low >= percent * high)
        gone, at = flat(group.column("tried"))
        order = np.argsort(node[right], kind="stable")
        for k, i in enumerate(left.tolist()):
            if mine := gone[at[i] : at[i + 1]].tolist():
                place = np.minimum(np.searchsorted(node[right][order], mine), len(right) - 1)
                place = order[place]
                out[k, place[node[right][place] == mine]] = False
        return out

    def needed(key, group):
        token, p, q = (k.as_py() for k in key)
        t, node, n, last, other = (group.column(c).to_numpy() for c in ("t", "node", "n", "last", "other"))
        n = n.astype(np.int64)
        values, at = flat(group.column("own"))
        row = np.repeat(np.arange(len(node)), np.diff(at))
        names, code = np.unique(values, return_inverse=True)
        left, right = np.flatnonzero(t == p), np.flatnonzero(t == q)
        use = left[:0]
        if len(left) and len(right):
            open_ = could(group, left, right)
            before, cut = None, int(np.searchsorted(names, token))
            shared = np.zeros(open_.shape, np.float32)
            for c, end in [(c, min(c + 1024, stop)) for first, stop in ((0, cut), (cut, len(names))) for c in range(first, stop, 1024)]:
                if c >= cut and before is None:
                    before = shared.copy()
                block = np.zeros((len(node), end - c), np.float32)
                hit = (code >= c) & (code < end)
                block[row[hit], code[hit] - c] = 1
                shared += block[left] @ block[right].T
            # A pair is this token's if no lesser one has both, and must share enough of its prefixes (see by_prefix).
            rest = -(-n * percent // 100) - 1
            most = shared + np.minimum(other[left, None], other[None, right]) + np.where(last[left, None] <= last[None, right], rest[left, None], rest[None, right])
            open_ &= (before == 0) & (most * (100 + percent) >= percent * (n[left, None] + n[None, right]))
            use = np.unique(np.concatenate((left[open_.any(1)], right[open_.any(0)])))
        return pa.table({"token": pa.array([token] * len(use), pa.int64()), "p": pa.array([p] * len(use), pa.int32()), "q": pa.array([q] * len(use), pa.int32()), "t": pa.array(t[use]), "node": pa.array(node[use])})

    wanted = C.stored(rows.groupBy("token", "p", "q").applyInArrow(needed, "token long, p int, q int, t int, node long"))
    ids = wanted.select("node").distinct()
    comps = members.select("node", F.col("n").cast("long").alias("n"), "comp").distinct()
    sets = _whole_sets(docs, facts.join(ids, "node", "left_semi"), width, levels).join(comps, "node").join(own, "node")
    sets = C.stored(sets.select("node", "tokens", "n", "comp", "own", "tried"))

    def compare(key, group):
        token, p, q = (k.as_py() for k in key)
        values, at = flat(group.column("tokens"))
        t, node, n = (group.column(c).to_numpy() for c in ("t", "node", "n"))
        lists, ends = flat(group.column("own"))
        lesser = [set(x[x < token].tolist()) for x in np.split(lists, ends[1:-1])]
        # Tokens of one node alone are in no intersection.
        names, code, count = np.unique(values, return_inverse=True, return_counts=True)
        common = count[code] > 1
        sums = np.concatenate(([0], np.cumsum(common)))
        code, at = code[common], sums[at]
        left, right = np.flatnonzero(t == p), np.flatnonzero(t == q)
        a, b = [], []
        if len(left) and len(right):
            open_ = could(group, left, right)
            flag = np.zeros(len(names), bool)
            for k, i in enumerate(left.tolist()):
                others = right[open_[k]]
                flag[code[at[i] : at[i + 1]]] = True
                for j in others.tolist():
                    if p == q and node[i] > node[j] or lesser[i] and not lesser[i].isdisjoint(lesser[j]):
                        continue  # the other order's, or another token's
                    shared = int(np.count_nonzero(flag[code[at[j] : at[j + 1]]]))
                    if every or 100 * shared >= percent * (n[i] + n[j] - shared):
                        a.append(node[i])
                        b.append(node[j])
                flag[code[at[i] : at[i + 1]]] = False
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        if every:
            return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})
        nodes, least = C._roots(a, b)
        keep = nodes != least
        return pa.table({"a": pa.array(least[keep], pa.int64()), "b": pa.array(nodes[keep], pa.int64())})

    return C.stored(wanted.join(sets, "node").groupBy("token", "p", "q").applyInArrow(compare, "a long, b long"))


def _whole_sets(docs: DataFrame, nodes: DataFrame, width: int, levels) -> DataFrame:
    """(node, tokens) of the nodes (node, ka, kb): their sorted tokens, from one text each."""
    sent = docs.sparkSession.sparkContext.broadcast(levels)

    @C.tidy
    def run(batches):
        for batch in C.small_batches(batches):
            tokens, at = _tokens(batch, width, sent.value)
            yield pa.RecordBatch.from_arrays([batch.column("node"), C.lists(C.signed(tokens), at)], ["node", "tokens"])

    nodes = C.stored(nodes.select("node", "ka", "kb"))
    texts = C.one_each(C.thinned(C.keyed(docs), "ka", C.key_filter(nodes.select("ka"))))
    return texts.join(nodes, ["ka", "kb"]).select("node", "text").mapInArrow(run, "node long, tokens array<long>")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, percent: int, levels) -> DataFrame:
    """The pairs (stored) whose sets link; only those that pass the suffix filter need their whole sets."""

    @C.tidy
    def suffix(batches):
        for batch in batches:
            n = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            ok = _most_shared(batch.column("ca"), batch.column("cb")) >= -(-percent * n // (100 + percent))
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    @C.tidy
    def exact(batches):
        for batch in batches:
            x, y = batch.column("ta"), batch.column("tb")
            xs, ys = x.values.to_numpy(), y.values.to_numpy()
            xo, yo = x.offsets.to_numpy(), y.offsets.to_numpy()
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                p, q = xs[xo[i] : xo[i + 1]], ys[yo[i] : yo[i + 1]]
                both = np.concatenate((p, q))
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                ok[i] = 100 * shared >= percent * (len(both) - shared)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    def side(df, end, **columns):
        return df.select(F.col("node").alias(end), *(F.col(c).alias(name) for name, c in columns.items()))

    some = C.thinned(nodes.select("node", "n", "classes"), "node", C.key_filter(pairs.select(F.explode(F.array("a", "b")).alias("node"))))
    left = pairs.join(side(some, "a", na="n", ca="classes"), "a")
    both = left.join(side(some, "b", nb="n", cb="classes"), "b").select("a", "b", "na", "nb", "ca", "cb")
    likely = C.stored(both.mapInArrow(suffix, "a long, b long"))
    ids = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    whole = C.stored(_whole_sets(docs, nodes.join(ids, "node", "left_semi"), width, levels))
    both = likely.join(side(whole, "a", ta="tokens"), "a").join(side(whole, "b", tb="tokens"), "b").select("a", "b", "ta", "tb")
    return C.stored(both.mapInArrow(exact, "a long, b long"))


def linked(nodes: DataFrame, docs: DataFrame, width: int, percent: int, levels, few: int, tile: int, trace: dict | None = None) -> DataFrame:
    """(id, component_id) of the nodes that link with others.  trace: gets the pairs that each way verifies, for tests."""
    postings = shared_postings(nodes)
    first = C.stored(chained_pairs(postings, percent))
    reached = C.components(verified(first, nodes, docs, width, percent, levels))
    left = open_postings(postings, reached, percent)
    members = left.where(F.col("size") > few).select("token", "node", "n", "comp")
    # own: long lists that a node is still in; other: tokens of its prefix that other nodes have too, but for those.
    inside = members.groupBy("node").agg(F.array_sort(F.collect_list("token")).alias("own"))
    held = postings.groupBy("node").agg(F.count("*").alias("held"))
    facts = nodes.select("node", "ka", "kb", "n", F.element_at("prefix", -1).alias("last")).join(C.stored(left.select("node").distinct()), "node", "left_semi")
    facts = facts.join(held, "node").join(inside, "node", "left")
    facts = C.stored(facts.withColumn("other", F.col("held") - F.coalesce(F.size("own"), F.lit(0))).drop("held"))
    pairs = by_prefix(few_pairs(left.where(F.col("size") <= few), percent), facts, percent)
    second = C.stored(pairs.join(first, ["a", "b"], "left_anti"))
    links = verified(second, nodes, docs, width, percent, levels) if second.take(1) else second
    if members.take(1):
        args = (members, facts, first, docs, width, percent, levels, tile)
        links = links.union(tile_links(*args))
        if trace is not None:
            trace["tiles"] = tile_links(*args, every=True)
    if trace is not None:
        trace |= {"first": first, "second": second}
    return C.components(reached.select(F.col("component_id").alias("a"), F.col("id").alias("b")).union(links))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, few: int = 16, tile: int = 256, trace: dict | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of documents (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = rows.where("doc_id is not null")
    levels = frequency_levels(docs, width)
    sets = C.stored(sketches(docs, width, percent, levels))
    nodes = different_sets(sets)
    found = linked(nodes, docs, width, percent, levels, few, tile, trace)
    # Copies follow their node, and a component has its least doc_id as a name.
    named = nodes.select("node", "digest_a", "digest_b", "n").join(found.withColumnRenamed("id", "node"), "node", "left").select("digest_a", "digest_b", "n", F.coalesce("component_id", "node").alias("group"))
    ids = sets.where("n > 0").groupBy("digest_a", "digest_b", "n").agg(F.min("doc_id").alias("least"))
    named = C.stored(named.join(ids, ["digest_a", "digest_b", "n"]))
    least = C.stored(named.groupBy("group").agg(F.min("least").alias("component_id")))
    named = C.stored(named.join(least, "group").select("digest_a", "digest_b", "n", "component_id"))
    out = sets.select("doc_id", "n", "digest_a", "digest_b").join(named, ["digest_a", "digest_b", "n"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    nameless = sketches(rows.where("doc_id is null"), width, percent, levels)
    return out.union(nameless.select("doc_id", "n", F.col("doc_id")))


def kept(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component stays, that of the least id; the columns are those of ``docs``.

    Rows without doc_id stay; rows that repeat the least id stay as often as they came.
    """
    gone = near_duplicates(docs, width, percent).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti").select(*docs.columns)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; odd rows as the module says."""
    return near_duplicates(C.table(spark, sf_dir, "documents", "doc_id", "text"))


#: The same for DuckDB, which counts all pairs that share a shingle.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, hash(list_slice(w, i, i + 4)) AS g, md5(array_to_string(list_slice(w, i, i + 4), ' ')) AS m FROM w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS r(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.m = b.m AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
ends AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN ends l ON l.a = r.c),
least AS (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least.component_id
FROM documents d JOIN least ON least.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
