"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

Two dictionaries share a base of frequent words, in the same place.  Before it,
in the same size, one has the forms (words or their first letters) that toxic
training texts have significantly more of, the other the forms that ordinary
training texts have significantly more of and then their rarer words.  Ordinary
text so compresses to about the same length with both, and what is typical of
toxic text compresses shorter with the first.  Windows of twenty words are
compressed with both; how the differences of a text's windows are spread
(largest, mean, share and number over thresholds) is calibrated to a probability
by logistic regression.

The texts that calibrate are seen by no dictionary: each quarter of the training
texts in turn goes through dictionaries of the other three.  The same tells how
significant forms must be (``LEVELS``): the level that tells those texts apart
best.  The dictionaries that score are then made of all training texts at it.

Dictionaries and calibration learn from at most ``sample`` labelled documents of
each class, none of them held out.  Without labels of both classes (so also for
an empty table of labels) all scores are 0; an empty table of documents gives no
rows.  Nulls, empty texts and texts without words are one empty window and have
its score.  Windows have no limit in length, so a text without white space is
one window; very long texts are taken whole, in batches of their own.  Repeated
rows get equal scores; rows without doc_id are scored and not held out.  Equal
levels are decided for the highest, equal forms by their letters, so reruns
agree.  Further columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SAMPLE = 1200
WINDOW = 20
BASE_BYTES = 24_000
#: Standard deviations by which a form must be more frequent in one class: what is chosen from, the strictest first.
LEVELS = (6.0, 5.0, 4.0, 3.0)
#: Different words of a form that count in a text; parts of the training texts that are left out in turn.
MOST, PARTS = 4, 4
LEVEL = 9
STEMS = (4, 5, 6, 7)
THRESHOLD = 0.3

_LETTERS = re.compile(r"\w+")


def _forms(word: str) -> list[str]:
    return [word, *(word[:k] for k in STEMS if len(word) > k)]


def _moments(texts: list[str]) -> tuple[Counter, Counter]:
    """Sums over texts of how many different words have a form, up to MOST, and of its square."""
    once, squared = Counter(), Counter()
    for t in texts:
        for f, k in Counter(f for w in set(_LETTERS.findall(t.lower())) for f in _forms(w)).items():
            once[f] += min(k, MOST)
            squared[f] += min(k, MOST) ** 2
    return once, squared


def vocabulary(toxic: list[str], plain: list[str], level: float) -> tuple[list[str], list[str], list[str]]:
    """The forms typical of toxic texts and of ordinary ones, most typical first, and the base: frequent words of both."""
    (a, a2), (b, b2), n, m = _moments(toxic), _moments(plain), len(toxic), len(plain)

    def z(form: str) -> float:
        """By how many standard deviations the form's mean number is higher in toxic texts."""
        variance = (a2[form] + b2[form] + 1) / (n + m) - ((a[form] + b[form]) / (n + m)) ** 2
        return (a[form] / n - b[form] / m) / (variance * (1 / n + 1 / m)) ** 0.5

    def typical(counts: Counter, sign: int) -> list[str]:
        """Forms over the level; of a form and its beginnings the most typical, the longest of equal ones."""
        out, begun, chosen = [], set(), set()
        for _, f in sorted(((round(sign * z(f), 6), f) for f in counts if sign * z(f) >= level), key=lambda x: (-x[0], -len(x[1]), x[1])):
            if f not in begun and not any(f[:k] in chosen for k in range(1, len(f))):
                out.append(f)
                chosen.add(f)
                begun.update(f[:k] for k in range(1, len(f) + 1))
        return out

    strong, usual = typical(a, 1), typical(b, -1)
    in_toxic = Counter(w for t in toxic for w in _LETTERS.findall(t.lower()))
    in_plain = Counter(w for t in plain for w in _LETTERS.findall(t.lower()))
    begins = set(strong)
    base, size = [], 0
    for w, _ in sorted((in_toxic + in_plain).items(), key=lambda x: (-x[1], x[0])):
        if size > BASE_BYTES:
            break
        if not any(w[:k] in begins for k in range(1, len(w) + 1)):
            base.append(w)
            size += len(w.encode()) + 1
    return strong, usual + [w for w in base[::-1] if w in in_plain], base


def dictionaries(words: tuple[list[str], list[str], list[str]]) -> tuple[bytes, bytes]:
    """The contents of the toxic and of the ordinary dictionary: as many bytes of either's own before the base."""
    shared = " ".join(words[2][::-1]).encode()[:BASE_BYTES]
    room = sum(len(w.encode()) + 1 for w in words[0])

    def own(typical: list[str]) -> bytes:
        out, size = [], 0
        for w in typical:
            if size + len(w.encode()) + 1 > room:
                break
            out.append(w)
            size += len(w.encode()) + 1
        text = " ".join(out).encode()
        return b"#" * (room - 1 - len(text)) + b" " + text + b" "

    return own(words[0]) + shared, own(words[1]) + shared


def train(toxic: list[str], plain: list[str], level: float = LEVELS[-1]) -> tuple[bytes, bytes]:
    """The contents of the toxic and of the ordinary dictionary."""
    return dictionaries(vocabulary(toxic, plain, level))


def auc(score: np.ndarray, y: np.ndarray) -> float:
    """How often a toxic text has a higher score than an ordinary one; equal scores count half."""
    ordinary = np.sort(score[y == 0])
    below = np.searchsorted(ordinary, score[y == 1], "left") + np.searchsorted(ordinary, score[y == 1], "right")
    return float(below.mean() / 2 / len(ordinary))


_COMPRESSORS: dict = {}


def _compressors(dictionaries: tuple[bytes, bytes]):
    if dictionaries not in _COMPRESSORS:
        import zstandard as Z

        _COMPRESSORS.clear()
        _COMPRESSORS[dictionaries] = [Z.ZstdCompressor(level=LEVEL, dict_data=Z.ZstdCompressionDict(d, dict_type=Z.DICT_TYPE_RAWCONTENT)).compress for d in dictionaries]
    return _COMPRESSORS[dictionaries]


def features(text: str | None, dictionaries: tuple[bytes, bytes]) -> tuple[float, ...]:
    """How much shorter the text's windows are with the toxic dictionary."""
    toxic, plain = _compressors(dictionaries)
    words = (text or "").lower().split()
    windows = [f" {' '.join(words[i : i + WINDOW])} ".encode("utf-8", "replace") for i in range(0, len(words), WINDOW)] or [b""]
    d = np.sort(np.array([len(plain(w)) - len(toxic(w)) for w in windows]))[::-1]
    total = sum(map(len, windows))
    spread = (d[0], d[:3].mean(), d[:8].mean(), d.mean(), np.clip(d, 0, 4).mean(), 100 * d.sum() / max(1, total))
    over = ((d >= 2).mean(), (d >= 3).mean(), (d >= 4).mean(), (d >= 2).sum(), (d >= 3).sum(), (d >= 5).sum(), np.maximum(d - 1, 0).sum())
    return (*spread, *over, np.log(len(d)))


class Calibration:
    """Logistic regression by Newton steps, with a weight for each class so that probabilities are those of the corpus."""

    def __init__(self, x: np.ndarray, y: np.ndarray, share: float):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        a = self._design(x)
        weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
        self.w = np.zeros(a.shape[1])
        for _ in range(60):
            p = self._probability(a)
            hessian = a.T @ (a * (weight * p * (1 - p))[:, None]) + 0.1 * np.eye(len(self.w))
            self.w += np.clip(np.linalg.solve(hessian, a.T @ (weight * (y - p)) - 0.1 * self.w), -2, 2)

    def _design(self, x):
        return np.c_[np.clip((x - self.mean) / self.scale, -8, 8), np.ones(len(x))]

    def _probability(self, a):
        return 1 / (1 + np.exp(-np.clip(a @ self.w, -30, 30)))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._probability(self._design(x))


def fit(spark: SparkSession, sf_dir: str, sample: int = SAMPLE):
    """(dictionaries, calibration), or None where either class has no labels."""
    texts, y = C.labelled_sample(spark, sf_dir, "toxic", sample)
    toxic, plain = ([t for t, v in zip(texts, y, strict=True) if v == k] for k in (1, 0))
    if len(toxic) < 4 or len(plain) < 4:
        return None
    counts = dict(C.table(spark, sf_dir, "labels", "doc_id", "toxic").where(F.col("toxic").isin(0, 1) & (C.label_side() != 2)).groupBy("toxic").count().collect())
    sent = spark.sparkContext.broadcast((toxic, plain))

    @C.tidy
    def unseen(batches):
        """Features of a part of the texts by dictionaries of the other parts."""
        for batch in batches:
            for level, part in zip(batch.column("level").to_pylist(), batch.column("part").to_pylist(), strict=True):
                pair = train(*([t for i, t in enumerate(texts) if i % PARTS != part] for texts in sent.value), level)
                x = np.array([features(t, pair) for texts in sent.value for t in texts[part::PARTS]], float)
                yield pa.RecordBatch.from_arrays([pa.array([level]), pa.array([part], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["level", "part", "x"])

    # A task for each level and part; the features, of a bounded number of texts, come to the driver.
    jobs = [(level, part) for level in LEVELS for part in range(PARTS)]
    tasks = spark.createDataFrame(jobs, "level double, part int").repartition(len(jobs)).mapInArrow(unseen, "level double, part int, x binary")
    blobs = {(r.level, r.part): r.x for r in tasks.collect()}
    y = np.concatenate([[1] * len(toxic[part::PARTS]) + [0] * len(plain[part::PARTS]) for part in range(PARTS)])
    best = None
    for level in LEVELS:
        x = np.concatenate([np.frombuffer(blobs[level, part]) for part in range(PARTS)]).reshape(len(y), -1)
        calibration = Calibration(x, y, counts[1] / (counts[0] + counts[1]))
        if best is None or auc(calibration(x), y) > best[0]:
            best = auc(calibration(x), y), level, calibration
    return train(toxic, plain, best[1]), best[2]


def scored(docs: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @C.tidy
    def run(batches):
        for batch in C.small_batches(batches):
            model = sent.value
            score = np.zeros(batch.num_rows)
            if model is not None:
                score = model[1](np.array([features(t, model[0]) for t in batch.column("text").to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", F.coalesce(C.label_side() == 2, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; odd rows as the module says."""
    return scored(C.table(spark, sf_dir, "documents", "doc_id", "text"), fit(spark, sf_dir))
