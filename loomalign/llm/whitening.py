"""Embedding whitening: exact distributed scatter, cyclic Jacobi on the driver, whitened components for every vector.

Components become integers, floor(1024 c) + 100000, so counts, sums and the
scatter around a whole-numbered centre are exact, whatever the order in which
tasks add them: reruns and recomputed tasks agree to the last bit.  What crosses
the network is one row for each pair of dimensions and task, added up by partial
aggregation; the driver gets one d x d matrix for each vector length and turns
it by cyclic Jacobi rotations (each sweep meets every pair of dimensions once, in
rounds of disjoint pairs) until every off-diagonal entry is below 1e-15 of the
geometric mean of its diagonal ones, which keeps small eigenvalues accurate
where a reduction to tridiagonal form loses them.  The matrix of the leading
components, scaled by eigenvalues, is broadcast: d x 8 numbers.

Size on the driver and in each task: d^2 numbers for each different d.  A
scatter by tiles of dimensions would be the way beyond some 5,000 dimensions.

Vectors that are null or hold null or non-finite entries are left out; an empty
vector has no component and gives no row.  Vectors of different length are lists
of their own (own n, sums, components).  Zero vectors, repeated rows and rows
without vec_id count and come out like others.  Where a list has fewer than
eight dimensions it has that many components.  A component whose eigenvalue is
zero to working precision (fewer rows than dimensions, constant dimensions) has
null whitened; identity_error is taken over the other ones and null without any.
explained is null where nothing varies.  Equal eigenvalues: their order, and the
basis of their plane, are what the rotations leave; the same for all rows.  The
sign makes the entry of greatest absolute value (the first of them) positive.
Entries beyond 2^53 / 1024 are cut to that, so that integers stay exact.  A
deviation beyond 64 bits is null.  An empty table gives no rows; further columns,
whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

COMPONENTS = 8
#: Entries as whole numbers.
SCALE, SHIFT = 1024, 100_000
_MOST = float(1 << 53)
#: Rows that are worked on at a time.
BLOCK = 4096
#: Sums of a task up to which decimals add them exactly; greater ones are added as doubles.
_EXACT = 10**27
#: Eigenvalues below this share of the trace are taken for zero.
RANK = 1e-13


def _vectors(batches, block: int = BLOCK):
    """(vec_id, integer vectors) of equal length from Arrow batches."""
    for batch in batches:
        column = batch.column("embedding")
        sizes = column.value_lengths().to_numpy(zero_copy_only=False)
        values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
        at = np.concatenate(([0], np.cumsum(sizes)))
        for d in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == d)
            for k in range(0, len(rows), block):
                part = rows[k : k + block]
                x = values[at[part][:, None] + np.arange(d)]
                yield batch.column("vec_id").take(pa.array(part)), np.clip(np.floor(x * SCALE) + SHIFT, -_MOST, _MOST).astype(np.int64)


def finite() -> F.Column:
    """Whether a vector and all its entries are there and finite."""
    return F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _rows(vectors: DataFrame) -> DataFrame:
    good = vectors.where(finite() & (F.size("embedding") > 0))
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def _cells(dims, cells, values) -> pa.RecordBatch:
    """Sums of a task: as decimals where many of them stay exact, else as doubles."""
    exact = [v if abs(v) < _EXACT else None for v in values]
    rough = [float(v) if abs(v) >= _EXACT else 0.0 for v in values]
    return pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), pa.array(cells, pa.int64()), pa.array(exact, pa.decimal128(38, 0)), pa.array(rough, pa.float64())], ["dim", "cell", "exact", "rough"])


def _summed(rows: DataFrame, count) -> dict[int, dict[int, int]]:
    """Sums over all rows by vector length and cell; ``count(x)`` gives the exact integers that a block adds to its cells."""

    @C.tidy
    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for _, x in _vectors(batches):
            d, part = x.shape[1], count(x)
            sums[d] = sums[d] + part if d in sums else part
        for d, s in sums.items():
            at = np.flatnonzero(s != 0)
            yield _cells([d] * len(at), at, s[at].tolist())

    cells = rows.mapInArrow(run, "dim int, cell long, exact decimal(38,0), rough double")
    out: dict[int, dict[int, int]] = {}
    for r in cells.groupBy("dim", "cell").agg(F.sum("exact").alias("exact"), F.sum("rough").alias("rough")).collect():
        out.setdefault(r.dim, {})[r.cell] = int(r.exact or 0) + int(r.rough)
    return out


def _ones_and_sums(x: np.ndarray) -> np.ndarray:
    """The number of rows, then the sums, as whole numbers of any size."""
    fits = int(np.abs(x).max()) * len(x) < 1 << 62
    s = x.sum(axis=0) if fits else x.astype(object).sum(axis=0)
    return np.array([len(x), *s.tolist()], object)


def products(z: np.ndarray) -> np.ndarray:
    """z'z of whole numbers, exact: by floating point where no sum can pass 2^53."""
    if len(z) and int(np.abs(z).max()) ** 2 * len(z) < 1 << 53:
        f = z.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    o = z.astype(object)
    return o.T @ o


def moments(rows: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """By vector length: n, the sums S, and the covariance with divisor n, centred before multiplying."""
    sent = rows.sparkSession.sparkContext.broadcast
    first = {d: (c[0], np.array([c.get(i + 1, 0) for i in range(d)], object)) for d, c in _summed(rows, _ones_and_sums).items()}
    centres = {d: np.array([int(round(v / n)) for v in s], np.int64) for d, (n, s) in first.items()}
    shared = sent(centres)

    def scatter(x):
        z = x - shared.value[x.shape[1]]
        return products(z)[np.triu_indices(x.shape[1])]

    out = {}
    for d, c in _summed(rows, scatter).items() if first else ():
        n, s = first[d]
        i, j = np.triu_indices(d)
        # What the rounding of the centre leaves, at most half a unit in each dimension.
        rest = [(int(v) - n * int(m)) / n for v, m in zip(s, centres[d], strict=True)]
        v = np.zeros((d, d))
        v[i, j] = [c.get(k, 0) / n - rest[a] * rest[b] for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True))]
        out[d] = (n, s, np.triu(v) + np.triu(v, 1).T)
    for d, (n, s) in first.items():  # a list in which nothing varies has no cell
        out.setdefault(d, (n, s, np.zeros((d, d))))
    shared.unpersist()
    return out


def _rounds(d: int):
    """Every pair of 0 to d - 1 once, in rounds of disjoint pairs (a round robin)."""
    seats = list(range(d + d % 2))
    half = len(seats) // 2
    for _ in range(len(seats) - 1):
        pairs = [(min(a, b), max(a, b)) for a, b in zip(seats[:half], seats[half:][::-1], strict=True) if max(a, b) < d]
        yield np.array([p for p, _ in pairs], np.intp), np.array([q for _, q in pairs], np.intp)
        seats = [seats[0], seats[-1], *seats[1:-1]]


def jacobi(matrix: np.ndarray, tolerance: float = 1e-15, most_sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix by cyclic Jacobi rotations."""
    a, d = np.array(matrix, np.float64), len(matrix)
    v = np.eye(d)
    rounds = list(_rounds(d)) if d > 1 else []
    tiny = np.finfo(float).tiny
    for _ in range(most_sweeps):
        turned = False
        for p, q in rounds:
            app, aqq, apq = a[p, p], a[q, q], a[p, q]
            act = np.abs(apq) > tolerance * np.sqrt(np.maximum(np.abs(app), tiny)) * np.sqrt(np.maximum(np.abs(aqq), tiny))
            act &= np.abs(apq) > 1e-60 * np.abs(np.diag(a)).max()  # where diagonal entries are zero
            if not act.any():
                continue
            turned = True
            p, q, app, aqq, apq = p[act], q[act], app[act], aqq[act], apq[act]
            theta = (aqq - app) / (2 * apq)
            t = np.where(theta >= 0, 1.0, -1.0) / (np.abs(theta) + np.hypot(theta, 1))
            c = 1 / np.hypot(t, 1)
            s = t * c
            rp, rq = a[p], a[q]
            a[p], a[q] = c[:, None] * rp - s[:, None] * rq, s[:, None] * rp + c[:, None] * rq
            cp, cq = a[:, p], a[:, q]
            a[:, p], a[:, q] = cp * c - cq * s, cp * s + cq * c
            # The turned entries as the formulas have them, not as rounding leaves them.
            a[p, p], a[q, q] = app - t * apq, aqq + t * apq
            a[p, q] = a[q, p] = 0.0
            vp, vq = v[:, p], v[:, q]
            v[:, p], v[:, q] = vp * c - vq * s, vp * s + vq * c
        if not turned:
            break
    values = np.diag(a).copy()
    order = np.argsort(-values, kind="stable")
    values, v = values[order], v[:, order]
    if d:
        v *= np.where(v[np.argmax(np.abs(v), axis=0), np.arange(d)] < 0, -1.0, 1.0)
    return values, v


def _models(rows: DataFrame, components: int) -> dict[int, tuple]:
    """By vector length: n, S, the leading axes over the roots of their eigenvalues (null ones are nan), shares explained."""
    out = {}
    for d, (n, s, cov) in moments(rows).items():
        values, axes = jacobi(cov)
        k, trace = min(components, d), float(np.trace(cov))
        e = values[:k]
        good = e > RANK * max(trace, 0.0)
        scaled = np.where(good, axes[:, :k] / np.sqrt(np.where(good, e, 1.0)), np.nan)
        out[d] = (n, s, scaled, e / trace if trace > 0 else np.full(k, np.nan))
    return out


def _deviations(x: np.ndarray, n: int, s: np.ndarray) -> tuple[np.ndarray, list]:
    """(centred rows, exact sums of (n x - S)^2, null beyond 64 bits)."""
    top = n * int(np.abs(x).max()) + max(abs(int(v)) for v in s)
    if top < 1 << 62:
        z = x * np.int64(n) - s.astype(np.int64)
        centred = z / n
        if int(np.abs(z).max()) ** 2 * x.shape[1] < 1 << 63:
            return centred, (z * z).sum(axis=1).tolist()
        z = z.astype(object)
    else:
        z = x.astype(object) * n - s
        centred = np.array([[v / n for v in row] for row in z.tolist()])
    sums = (z * z).sum(axis=1).tolist()
    return centred, [v if v < 1 << 63 else None for v in sums]


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``SCHEMA``, for every row of vectors (vec_id, embedding) with finite entries and each of its leading components."""
    rows = _rows(vectors)
    context = vectors.sparkSession.sparkContext
    models = context.broadcast(_models(rows, components))

    def projected(x):
        n, s, scaled, shares = models.value[x.shape[1]]
        centred, deviation = _deviations(x, n, s)
        return centred @ scaled, deviation, n, shares

    def check(batches):
        """Sums of the whitened components and of their products, a row for each vector length."""
        sums: dict[int, list] = {}
        for _, x in _vectors(batches):
            y = projected(x)[0]
            part = [y.sum(axis=0), y.T @ y]
            sums[x.shape[1]] = [a + b for a, b in zip(sums[x.shape[1]], part, strict=True)] if x.shape[1] in sums else part
        for d, (one, two) in sums.items():
            flat = np.concatenate((one, two.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(flat), pa.int32()), pa.array(range(len(flat)), pa.int32()), pa.array(flat)], ["dim", "cell", "value"])

    errors = {}
    found = rows.mapInArrow(C.tidy(check), "dim int, cell int, value double").groupBy("dim", "cell").agg(F.sum("value").alias("value")).collect()
    cells = {(r.dim, r.cell): r.value for r in found}
    for d, (n, _, scaled, _) in models.value.items():
        k = scaled.shape[1]
        flat = np.array([cells[d, i] for i in range(k + k * k)]) / n
        cov = flat[k:].reshape(k, k) - np.outer(flat[:k], flat[:k])
        off = np.abs(cov - np.eye(k))
        errors[d] = float(np.nanmax(off)) if np.isfinite(off).any() else None

    def out(batches):
        for ids, x in _vectors(batches):
            y, deviation, n, shares = projected(x)
            k, rows_ = y.shape[1], len(y)
            each = np.repeat(np.arange(rows_), k)
            flat, share = y.ravel(), np.tile(shares, rows_)
            columns = [ids.take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows_)), pa.array(np.full(rows_ * k, n)), pa.array(deviation, pa.int64()).take(pa.array(each)), pa.array(flat, mask=np.isnan(flat)), pa.array(share, mask=np.isnan(share)), pa.array([errors[x.shape[1]]] * (rows_ * k), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(C.tidy(out), SCHEMA)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``SCHEMA`` of every vector and its first eight components; odd rows as the module says."""
    return whitened(C.table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
