"""The k best targets of each query without scoring all of them, and the same result.

No alignment scores more than the best pairing of its residues could: each residue
of the target counts with its best partner in the query, the best of them as often
as the query has residues, and the same the other way round.  A global alignment
also pays for the difference of the lengths.  These bounds need the counts of the
24 codes alone.  The k-th best score of a first sample is a threshold that the k
best of all cannot lie below; a task also knows the k-th best of what it has
scored itself, and takes targets in falling order of their bounds.  What is
bounded below the threshold is never scored; what is equal to it is, since ties
go by id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomalign.functions.scoring import GAP_EXTEND, GAP_OPEN, MATRIX, algorithm_name, encode, encode_all
from loomalign.operators import kernels
from loomalign.operators.search import EACH, HELD, search, spread, top_hits
from loomalign.sources.staged import staged

#: Targets that are scored first, and that a task scores between two looks at its threshold.
SAMPLE, SLICE = 1000, 2048
_LETTERS = len(MATRIX)


def _greedy(values: np.ndarray, counts: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Sums of the best ``limit`` values of each row, where value c is there counts[:, c] times; values below 0 are left."""
    order = np.argsort(-values, kind="stable")
    upto = np.minimum(np.cumsum(counts[:, order], axis=1), limit[:, None])
    taken = np.diff(np.concatenate((np.zeros((len(counts), 1), np.int64), upto), axis=1), axis=1)
    return (taken * np.maximum(values[order], 0)).sum(axis=1)


def bounds(algorithm: str, q: np.ndarray, counts: np.ndarray, open_: int = GAP_OPEN, extend: int = GAP_EXTEND) -> np.ndarray:
    """What no score of the query with targets of these counts of codes (rows of 24) can pass."""
    n = counts.sum(axis=1)
    m = len(q)
    if m == 0 or not len(counts):
        high = np.zeros(len(counts), np.int64)
    else:
        own = np.bincount(q, minlength=_LETTERS).astype(np.int64)
        wide = MATRIX.astype(np.int64)
        high = _greedy(wide[own > 0].max(axis=0), counts, np.full(len(counts), m))
        # From the query's side: its residues with the best partner that the target has.
        kinds, kind = np.unique(counts > 0, axis=0, return_inverse=True)
        alike = np.split(np.argsort(kind.ravel(), kind="stable"), np.cumsum(np.bincount(kind.ravel()))[:-1])
        for present, rows in zip(kinds, alike, strict=True):
            best = wide[:, present].max(axis=1) if present.any() else np.zeros(_LETTERS, np.int64)
            high[rows] = np.minimum(high[rows], _greedy(best, np.repeat(own[None, :], len(rows), 0), n[rows]))
    return high if algorithm == "sw" else high - kernels.gap(np.abs(n - m), open_, extend)


def _counts(seqs: list[np.ndarray]) -> np.ndarray:
    sizes = np.array([len(s) for s in seqs], np.int64)
    row = np.repeat(np.arange(len(seqs)), sizes)
    flat = np.concatenate(seqs) if seqs else np.zeros(0, np.uint8)
    return np.bincount(row * _LETTERS + flat, minlength=len(seqs) * _LETTERS).reshape(len(seqs), _LETTERS)


def bounded_top_hits(targets: DataFrame, query: str | dict[str, str], k: int, algorithm: str = "sw", threshold: int = 4096, sample: int = SAMPLE, gap_open: int = GAP_OPEN, gap_extend: int = GAP_EXTEND) -> tuple[DataFrame, DataFrame]:
    """(hits, work): what ``top_hits`` of a whole search gives, and (query_id, targets, scored, cells, scored_cells) of each query.

    Targets (target_id, seq, len) with a null sequence are no hits.  The
    sample's scores are in the work too.
    """
    algorithm_name(algorithm)
    if k < 1:
        raise ValueError("k is a positive number")
    queries = query if isinstance(query, dict) else {"query": query}
    rows = targets.where("seq is not null")
    options = {"gap_open": gap_open, "gap_extend": gap_extend}
    first = rows.orderBy(F.xxhash64("target_id"), "target_id").limit(max(sample, k))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"))
    kth = search(first, queries, algorithm, threshold, **options).withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") == k)
    low = {r.query_id: r.score for r in kth.select("query_id", "score").collect()}
    sent = rows.sparkSession.sparkContext.broadcast([(name, encode(q), low.get(name)) for name, q in queries.items()])

    def some(ids, seqs, lens, known):
        counts = _counts(seqs)
        for name, q, start in sent.value:
            limit = bounds(algorithm, q, counts, gap_open, gap_extend)
            order = np.argsort(-limit, kind="stable")
            floor = known.get(name, start)
            top = known.get((name, "top"), np.zeros(0, np.int64))
            done, cells, keep_i, keep_s = 0, 0, [], []
            while done < len(order):
                part = order[done : done + SLICE]
                if floor is not None:
                    part = part[limit[part] >= floor]
                if not len(part):
                    break
                score = kernels.scores(algorithm, q, [seqs[i] for i in part.tolist()], threshold, gap_open, gap_extend)
                cells += len(q) * sum(len(seqs[i]) for i in part.tolist())
                done += len(part)
                keep_i.append(part)
                keep_s.append(score)
                top = -np.sort(-np.concatenate((top, score)))[:k]
                if len(top) == k:
                    floor = int(top[-1]) if floor is None else max(floor, int(top[-1]))
            known[name], known[name, "top"] = floor, top
            at, score = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keep_i, keep_s))
            ok = score >= floor if floor is not None else np.ones(len(score), bool)
            # One row for the work, then the hits that may be among the best.
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * (1 + int(ok.sum()))),
                    pa.array([None, *(ids[i] for i in at[ok].tolist())], pa.int64()),
                    pa.array([None, *(lens[i] for i in at[ok].tolist())], pa.int32()),
                    pa.array([None, *score[ok].tolist()], pa.int32()),
                    pa.array([len(seqs)] + [0] * int(ok.sum()), pa.int64()),
                    pa.array([done] + [0] * int(ok.sum()), pa.int64()),
                    pa.array([len(q) * int(counts.sum())] + [0] * int(ok.sum()), pa.int64()),
                    pa.array([cells] + [0] * int(ok.sum()), pa.int64()),
                ],
                ["query_id", "target_id", "len", "score", "targets", "scored", "cells", "scored_cells"],
            )

    def run(batches):
        known: dict = {}
        ids, seqs, lens, held = [], [], [], 0
        for batch in batches:
            ids += batch.column("target_id").to_pylist()
            lens += batch.column("len").to_pylist()
            codes = encode_all(batch.column("seq"))
            seqs += codes
            held += sum(map(len, codes)) + EACH * len(codes)
            if held > HELD:
                yield from some(ids, seqs, lens, known)
                ids, seqs, lens, held = [], [], [], 0
        if ids:
            yield from some(ids, seqs, lens, known)

    found = staged(spread(rows.select("target_id", "seq", "len")).mapInArrow(run, "query_id string, target_id long, len int, score int, targets long, scored long, cells long, scored_cells long"), "bounded")
    work = found.where("target_id is null and score is null").groupBy("query_id").agg(*(F.sum(c).alias(c) for c in ("targets", "scored", "cells", "scored_cells")))
    return top_hits(found, k), work
