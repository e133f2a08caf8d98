"""Quality by the votes of nearest labelled neighbours in a latent-semantic space.

A text is counted into cells of a fixed-size table: hashed words, word shapes
(runs of letters, capitals, digits and each symbol), pairs of adjacent shapes and
words equal to the word before.  Counts become logarithmic, weighted by inverse
document frequency over *all* documents, and normalised; the leading singular
vectors of the labelled sample make the latent space.

The labelled vectors (at most ``2 * sample``, of ``RANK`` numbers each: a proven
bound) are broadcast.  Every document is compared with all of them, a block of
documents at a time, by exact cosine products; its ``k`` nearest vote with their
similarity, weighted so that either class counts as in all labels.

Nulls, empty texts and texts without words score 0.  Without labels of both
classes (so also for an empty table of labels) every text scores 0; an empty
table of documents gives no rows.  Ties: cosines are taken in double precision
and rounded to nine decimals, so they don't depend on how rows are batched, and
of equal ones the neighbour of the least doc_id is nearer.  Very long texts are
taken whole, in batches of their own.  Repeated rows get equal scores; rows
without doc_id are scored and not held out.  Further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SAMPLE = 1000
RANK = 48
K = 15
THRESHOLD = 0.7
#: Cells for words, shapes and pairs of shapes, and one for repeated words.
PARTS = (2048, 1023, 1024)
CELLS = 4096
ROWS = 1024

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = 97
_CLASS[128:] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 48


def counted(batch: pa.RecordBatch) -> np.ndarray:
    """rows x CELLS: logarithmic counts."""
    data, offsets = C.text_buffers(batch.column("text"))
    n = batch.num_rows
    starts, ends, first = C.word_spans(data, offsets)
    if not len(starts):
        return np.zeros((n, CELLS), np.float32)
    doc = np.repeat(np.arange(n), np.diff(first))
    words = C.Rolling(C.lower_ascii(data)).of(starts, ends)
    kinds = _CLASS[data]
    head = np.ones(len(data), bool)
    head[1:] = kinds[1:] != kinds[:-1]
    head[starts] = True
    place = np.concatenate(([0], np.cumsum(head)))
    shapes = C.Rolling(kinds[head]).of(place[starts], place[ends])
    pairs = C.mixed(shapes[:-1] * np.uint64(3) + shapes[1:])
    inside = doc[1:] == doc[:-1]
    same = inside & (words[1:] == words[:-1])
    a, b, c = (np.uint64(x) for x in PARTS)
    cells = [words % a, a + shapes % b, (a + b) + pairs[inside] % c, np.full(int(same.sum()), CELLS - 1, np.uint64)]
    docs = [doc, doc, doc[1:][inside], doc[1:][same]]
    at = np.concatenate(docs) * CELLS + np.concatenate(cells).astype(np.int64)
    return np.log1p(np.bincount(at, minlength=n * CELLS).reshape(n, CELLS).astype(np.float32))


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """In how many documents each cell occurs."""

    def cells(batch):
        out = [np.zeros(0, np.int64)]
        for part in C.small_batches([batch], rows=ROWS):
            out.append(np.nonzero(counted(part))[1])
        return np.concatenate(out)

    return C.summed_table(docs.select("text"), cells, CELLS)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Neighbours:
    def __init__(self, texts: list[str], y: np.ndarray, frequency: np.ndarray, total: int, share: float):
        self.idf = np.log((total + 1) / (frequency + 1)).astype(np.float32) + 1
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
        x = np.concatenate([self.weighted(p) for p in C.small_batches([batch], rows=ROWS)])
        # Singular vectors by the smaller Gram matrix.
        wide = x.astype(np.float64)
        values, vectors = np.linalg.eigh(wide @ wide.T)
        top = np.argsort(values)[::-1][:RANK]
        top = top[values[top] > 1e-6 * values[top[0]]]
        self.basis = x.T.astype(np.float64) @ vectors[:, top] / np.sqrt(values[top])
        self.vectors = self.latent(x)
        self.y = y
        self.weight = np.where(y == 1, share / (y == 1).sum(), (1 - share) / (y == 0).sum())

    def weighted(self, batch) -> np.ndarray:
        return _unit(counted(batch) * self.idf)

    def latent(self, x: np.ndarray) -> np.ndarray:
        return _unit(x.astype(np.float64) @ self.basis)

    def nearest(self, x: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """(neighbours in the order of their ids, their cosines) of rows of latent vectors."""
        n = len(self.vectors)
        billionths = np.rint((x @ self.vectors.T) * 1e9).astype(np.int64)
        # One number for cosine and place: no two are equal.
        rank = billionths * n + np.arange(n - 1, -1, -1)
        k = min(k, n)
        near = np.sort(np.argpartition(rank, n - k, axis=1)[:, n - k :], axis=1)
        return near, np.take_along_axis(billionths, near, 1) / 1e9

    def score(self, batch: pa.RecordBatch, k: int = K) -> np.ndarray:
        x = self.weighted(batch)
        near, cosine = self.nearest(self.latent(x), k)
        vote = np.maximum(cosine, 1e-6) ** 8 * self.weight[near]
        out = (vote * self.y[near]).sum(1) / vote.sum(1)
        return np.where(x.any(1), out, 0.0)


def fit(spark: SparkSession, sf_dir: str, sample: int = SAMPLE) -> Neighbours | None:
    texts, y = C.labelled_sample(spark, sf_dir, "quality", sample)
    if len(set(y.tolist())) < 2:
        return None
    docs = C.table(spark, sf_dir, "documents", "text")
    counts = dict(C.table(spark, sf_dir, "labels", "doc_id", "quality").where(F.col("quality").isin(0, 1) & (C.label_side() != 2)).groupBy("quality").count().collect())
    return Neighbours(texts, y, document_frequencies(docs), docs.count(), counts[1] / (counts[0] + counts[1]))


def scored(docs: DataFrame, model: Neighbours | None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @C.tidy
    def run(batches):
        for batch in C.small_batches(batches, rows=ROWS):
            score = sent.value.score(batch) if sent.value is not None else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score.astype(np.float64)), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", F.coalesce(C.label_side() == 2, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; odd rows as the module says."""
    return scored(C.table(spark, sf_dir, "documents", "doc_id", "text"), fit(spark, sf_dir))
