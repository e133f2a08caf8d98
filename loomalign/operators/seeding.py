"""Search by seeds: exact scores for the targets in which two words of the query's neighbourhood lie on one diagonal.

An inverted index has a row (word, target_id, t_pos) for every k residues of every
target; words are numbers, rows lie in order of them, so a search reads only the
parts of the index that hold its words.  The neighbourhood of a query is every
word that scores ``least`` or more with k residues of it.  The join of both gives
seeds; two of them on one diagonal, at least k and at most ``within`` residues
apart, make a target a candidate, and candidates get the kernels' exact scores.
``search`` stays the exact way.

A neighbourhood of up to ``SMALL`` rows is sent to all tasks, where a word that a
third of the index has is no different from others; a larger one is joined with
every word's rows dealt over ``SALTS`` parts.

A search without an index needs none for a neighbourhood of up to ``LOOKED_UP``
rows: seeds lie in one target, so a task looks up the words of the targets that
it reads and gives those with two seeds on a diagonal (``matches``), whose scores
are dealt anew over all tasks.  No word and no seed is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomalign.functions.scoring import GAP_EXTEND, GAP_OPEN, MATRIX, UNKNOWN, algorithm_name, encode, encode_all
from loomalign.operators import kernels
from loomalign.operators.many import _tasks
from loomalign.operators.search import spread
from loomalign.sources.staged import drop, staged

K, LEAST, WITHIN = 3, 11, 40
#: Rows of a neighbourhood up to which it is broadcast (some 30 MB), and parts of a word's rows beyond it.
SMALL, SALTS = 1_000_000, 16
#: Rows of a neighbourhood up to which every task has it to look words up (16 bytes a row).
LOOKED_UP = 1 << 22
#: Residues of targets that a task looks up at a time.
_RESIDUES = 1 << 20
_BASE = len(MATRIX)
#: Index rows that a task holds at a time.
_HELD = 1 << 20


def words(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, position) of every k residues without an unknown one."""
    n = len(codes) - k + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    out, bad = np.zeros(n, np.int64), np.zeros(n, bool)
    for i in range(k):
        out = out * _BASE + codes[i : i + n]
        bad |= codes[i : i + n] == UNKNOWN
    at = np.flatnonzero(~bad)
    return out[at], at


def neighbourhood(codes: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, position): every word that scores ``least`` or more with the k residues at a position."""
    out_w, out_p = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    known = MATRIX[:, :UNKNOWN].astype(np.int64)
    top = known.max(axis=1)
    for at in range(len(codes) - k + 1):
        part = codes[at : at + k].astype(np.intp)
        rest = np.append(np.cumsum(top[part][::-1])[::-1][1:], 0)
        word, score = np.zeros(1, np.int64), np.zeros(1, np.int64)
        for i, code in enumerate(part.tolist()):
            score = (score[:, None] + known[code][None, :]).ravel()
            word = (word[:, None] * _BASE + np.arange(UNKNOWN)[None, :]).ravel()
            ok = score + rest[i] >= least  # what the residues to come can still add
            word, score = word[ok], score[ok]
        out_w.append(word)
        out_p.append(np.full(len(word), at))
    return np.concatenate(out_w), np.concatenate(out_p)


def word_rows(targets: DataFrame, k: int = K) -> DataFrame:
    """(word, target_id, t_pos) of every target (target_id, seq)."""

    def run(batches):
        for batch in batches:
            for i, seq in zip(batch.column("target_id").to_pylist(), batch.column("seq").to_pylist(), strict=True):
                word, at = words(encode(seq), k)
                for a in range(0, len(word), _HELD):
                    w = word[a : a + _HELD]
                    yield pa.RecordBatch.from_arrays([pa.array(w), pa.array([i] * len(w), pa.int64()), pa.array(at[a : a + _HELD].astype(np.int32))], ["word", "target_id", "t_pos"])

    return targets.where("seq is not null").select(F.col("target_id").cast("long").alias("target_id"), "seq").mapInArrow(run, "word long, target_id long, t_pos int")


def write_index(targets: DataFrame, path: str, k: int = K) -> None:
    """The inverted index as Parquet, in order of words: a search's words decide which row groups are read."""
    word_rows(targets, k).repartitionByRange("word", "target_id").sortWithinPartitions("word", "target_id").write.parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("word long, target_id long, t_pos int").parquet(path)


def query_words(queries: DataFrame, k: int = K, least: int = LEAST) -> DataFrame:
    """(word, query_id, q_pos): the neighbourhoods of queries (query_id, seq)."""

    def run(batches):
        for batch in batches:
            for name, seq in zip(batch.column("query_id").to_pylist(), batch.column("seq").to_pylist(), strict=True):
                word, at = neighbourhood(encode(seq), k, least)
                for a in range(0, len(word), _HELD):
                    w = word[a : a + _HELD]
                    yield pa.RecordBatch.from_arrays([pa.array(w), pa.array([name] * len(w)), pa.array(at[a : a + _HELD].astype(np.int32))], ["word", "query_id", "q_pos"])

    rows = queries.where("seq is not null").select(F.col("query_id").cast("string").alias("query_id"), "seq")
    return rows.repartition(_tasks(rows), "query_id").mapInArrow(run, "word long, query_id string, q_pos int")


def candidates(index: DataFrame, asked: DataFrame, k: int = K, within: int = WITHIN, small: int = SMALL) -> DataFrame:
    """(query_id, target_id): pairs with two seeds on one diagonal, k to ``within`` residues apart.

    asked: ``query_words``, read more than once (store them where they are many).
    """
    if asked.count() <= small:
        seeds = index.join(F.broadcast(asked), "word")
    else:
        salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
        dealt = index.withColumn("_salt", F.pmod(F.xxhash64("target_id", "t_pos"), F.lit(SALTS)).cast("int"))
        seeds = dealt.join(asked.withColumn("_salt", F.explode(salts)), ["word", "_salt"])
    seeds = seeds.select("query_id", "target_id", (F.col("t_pos") - F.col("q_pos")).alias("diagonal"), "t_pos")
    # A diagonal is as long as a query at most.
    before = Window.partitionBy("query_id", "target_id", "diagonal").orderBy("t_pos").rangeBetween(-within, -k)
    return seeds.withColumn("_n", F.count("*").over(before)).where("_n > 0").select("query_id", "target_id").distinct()


def _near(keys: np.ndarray, at: np.ndarray, own: np.ndarray, k: int, within: int) -> np.ndarray:
    """Which seeds have another one on their diagonal (``keys``) in their own target, k to ``within`` residues before them; ``at`` ascends."""
    order = np.argsort(keys, kind="stable")
    keys, at, own = keys[order], at[order], own[order]
    line = np.cumsum(np.concatenate(([False], keys[1:] != keys[:-1])))
    place = line * (int(at.max()) + within + 2) + at + within
    before = np.searchsorted(place, place - k, "right") - 1  # the last one k or more before
    there = np.maximum(before, 0)
    found = (before >= 0) & (line[there] == line) & (own[there] == own) & (place - place[there] <= within)
    return order[found]


class _Lookup:
    """The neighbourhood in order of words, and the pairs of a text and a query that it makes candidates."""

    def __init__(self, asked: pa.Table, k: int, within: int):
        names = asked.column("query_id").combine_chunks().dictionary_encode()
        word = asked.column("word").to_numpy()
        order = np.argsort(word, kind="stable")
        self.names, self.k, self.within = names.dictionary.to_pylist(), k, within
        self.query = names.indices.to_numpy()[order].astype(np.int32)
        self.place = asked.column("q_pos").to_numpy()[order].astype(np.int32)
        self.word, first = np.unique(word[order], return_index=True)
        self.first = np.append(first, len(word))

    def pairs(self, codes: list[np.ndarray]) -> list[tuple[int, int]]:
        """(text, query), by their numbers."""
        if not len(self.word) or not codes:
            return []
        ends = np.cumsum([len(c) + 1 for c in codes])
        apart = np.full(1, UNKNOWN, np.uint8)
        word, at = words(np.concatenate([x for c in codes for x in (c, apart)]), self.k)
        there = np.minimum(np.searchsorted(self.word, word), len(self.word) - 1)
        hit = self.word[there] == word
        there, at = there[hit], at[hit]
        own, count = np.searchsorted(ends, at, "right"), self.first[there + 1] - self.first[there]
        # So many seeds at a time, and again those that the next ones can lie on a diagonal with.
        total, start, out = np.cumsum(count), 0, set()
        while start < len(at):
            end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + _HELD, "right")))
            back = int(np.searchsorted(at, at[start] - self.within))
            n = count[back:end]
            row = np.arange(int(n.sum())) + np.repeat(self.first[there[back:end]] - (np.cumsum(n) - n), n)
            t, text, query = np.repeat(at[back:end], n), np.repeat(own[back:end], n), self.query[row].astype(np.int64)
            found = _near(query * (1 << 40) + t - self.place[row], t, text, self.k, self.within)
            out.update(zip(text[found].tolist(), query[found].tolist(), strict=True))
            start = end
        return sorted(out)


def matches(targets: DataFrame, asked: pa.Table, k: int = K, within: int = WITHIN) -> DataFrame:
    """(target_id, seq, queries): the targets that are candidates of a query, with the names of all of those.

    asked: ``query_words``, gathered.  Equal ids are targets of their own.
    """
    sent = targets.sparkSession.sparkContext.broadcast(_Lookup(asked, k, within))

    def run(batches):
        lookup = sent.value
        for batch in batches:
            codes = encode_all(batch.column("seq"))
            start = 0
            while start < len(codes):
                end, held = start + 1, len(codes[start])
                while end < len(codes) and held + len(codes[end]) <= _RESIDUES:
                    held += len(codes[end])
                    end += 1
                named: dict[int, list] = {}
                for text, query in lookup.pairs(codes[start:end]):
                    named.setdefault(start + text, []).append(lookup.names[query])
                if named:
                    rows = batch.take(pa.array(list(named)))
                    yield pa.RecordBatch.from_arrays([rows.column("target_id"), rows.column("seq"), pa.array(list(named.values()), pa.list_(pa.string()))], ["target_id", "seq", "queries"])
                start = end

    rows = targets.where("seq is not null and target_id is not null").select(F.col("target_id").cast("long").alias("target_id"), "seq")
    return rows.mapInArrow(run, "target_id long, seq string, queries array<string>")


def score_pairs(pairs: DataFrame, targets: DataFrame, queries: DataFrame, algorithm: str = "sw", threshold: int = 4096, gap_open: int = GAP_OPEN, gap_extend: int = GAP_EXTEND) -> DataFrame:
    """(query_id, target_id, len, score) of chosen pairs (query_id, target_id)."""
    algorithm_name(algorithm)
    of = pairs.groupBy("target_id").agg(F.collect_set("query_id").alias("queries"))
    rows = of.join(targets.where("seq is not null").select(F.col("target_id").cast("long").alias("target_id"), "seq"), "target_id")
    return score_matches(rows, queries, algorithm, threshold, gap_open, gap_extend)


def score_matches(rows: DataFrame, queries: DataFrame, algorithm: str = "sw", threshold: int = 4096, gap_open: int = GAP_OPEN, gap_extend: int = GAP_EXTEND) -> DataFrame:
    """(query_id, target_id, len, score) of targets (target_id, seq, queries) with each of the queries that they name.

    Targets are dealt over all tasks by an explicit number, since their cost is
    in cells and not in bytes; a task scores equal pairs of a batch once.
    """
    algorithm_name(algorithm)
    texts = queries.where("seq is not null").select(F.col("query_id").cast("string").alias("query_id"), F.col("seq").alias("_q"))
    dealt = rows.repartition(_tasks(rows), "target_id").select("target_id", F.col("seq").alias("_t"), F.explode("queries").alias("query_id"))

    def run(batches):
        for batch in batches:
            asked, given = (batch.column(c).dictionary_encode() for c in ("_q", "_t"))
            codes, seqs = encode_all(asked.dictionary), encode_all(given.dictionary)
            pairs, again = np.unique(np.stack((asked.indices.to_numpy(), given.indices.to_numpy())), axis=1, return_inverse=True)
            if algorithm == "sw":
                score = kernels.beside([codes[i] for i in pairs[0]], [seqs[i] for i in pairs[1]], gap_open, gap_extend)
            else:
                score = np.zeros(pairs.shape[1], np.int64)
                for i in range(len(codes)):
                    at = np.flatnonzero(pairs[0] == i)
                    score[at] = kernels.scores(algorithm, codes[i], [seqs[j] for j in pairs[1][at]], threshold, gap_open, gap_extend)
            lens = np.array([len(s) for s in seqs], np.int32)[given.indices.to_numpy()]
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("target_id"), pa.array(lens, pa.int32()), pa.array(score[again.ravel()].astype(np.int32))], ["query_id", "target_id", "len", "score"])

    return dealt.join(texts, "query_id").select("query_id", F.col("target_id").cast("long").alias("target_id"), "_q", "_t").mapInArrow(run, "query_id string, target_id long, len int, score int")


def seeded_search(targets: DataFrame, queries: DataFrame, index: DataFrame | None = None, algorithm: str = "sw", k: int = K, least: int = LEAST, within: int = WITHIN, **options) -> DataFrame:
    """(query_id, target_id, len, score) of the candidates among targets (target_id, seq) for queries (query_id, seq).

    index: ``read_index`` of the same targets and k; without one, words are made
    and looked up as the targets are read.
    """
    asked = staged(query_words(queries.where("query_id is not null"), k, least), "asked")
    if index is None and asked.count() <= LOOKED_UP:
        found = matches(spread(targets), asked.toArrow(), k, within)
        drop(asked)
        return score_matches(found, queries, algorithm, **options)
    index = word_rows(targets, k) if index is None else index
    return score_pairs(candidates(index, asked, k, within), targets, queries, algorithm, **options)


def recall(found: DataFrame, exact: DataFrame, k: int) -> float:
    """The share of the exact k best hits of each query (score above 0) that were found."""
    from loomalign.operators.search import top_hits

    best = top_hits(exact.where("score > 0"), k).select("query_id", "target_id")
    row = best.join(found.select("query_id", "target_id", F.lit(1).alias("hit")), ["query_id", "target_id"], "left").agg(F.count("*").alias("n"), F.count("hit").alias("hits")).first()
    return row.hits / row.n if row.n else 1.0
