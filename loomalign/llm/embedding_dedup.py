"""Near-duplicate embeddings: PCA-ordered tiled comparison with early stopping.

Vectors of one label are compared by cosine, all with all, in tiles.  They are
turned into the axes of a principal component analysis (fitted on a bounded
sample; any rotation keeps products, so it decides only the speed), the leading
dimensions of a pair of tiles are multiplied first, and what the remaining ones
could add is at most the product of the two suffix norms.  Pairs that cannot
reach the threshold are dropped, the others go on with the next dimensions; the
last ones are judged by the cosine of the vectors as given, in double precision.

Equal vectors collapse to one with a multiplicity before anything is compared.
Tiles hold about ``tile`` vectors of a label, dealt by hash, so a label with a
third of all rows is many tasks.  Each pair of tiles returns, instead of its
links, the number of links of each vector and a spanning forest of them; so
rows grow with vectors times tiles and not with links.

Vectors that are null, empty, zero or hold null or non-finite components, and
rows without a label or vec_id, link with nothing: n_links 0, a component of
their own (kept; null without vec_id).
Different vectors of one vec_id are judged each by itself.
Vectors of different length never link; an empty vector is like a null one, and
very long ones are compared like others, in tiles of as many rows.  Repeated
rows link with each other and come out as often as they came in.  Ties: a
cosine equal to the threshold links; a component's name is its least vec_id.  An
empty table gives no rows.  Further columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

TILE = 2048
STEP = 16
SAMPLE = 4096
THRESHOLD = 0.93


def _valid():
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nonzero = F.exists("embedding", lambda x: x != 0)
    return F.coalesce(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.col("label").isNotNull() & finite & nonzero, F.lit(False))


def rotations(vectors: DataFrame, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Principal axes by number of dimensions, of at most ``sample`` vectors in all; without any, the axes stay."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").select("embedding").limit(sample).collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r.embedding), []).append(r.embedding)
    out = {}
    for d, x in by.items():
        x = np.array(x, float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        values, axes = np.linalg.eigh(x.T @ x)
        out[d] = axes[:, np.argsort(values)[::-1]]
    return out


def linked(x: np.ndarray, y: np.ndarray, axes: np.ndarray | None, threshold: float, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of x and y whose cosine reaches the threshold."""
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    u, v = x / nx[:, None], y / ny[:, None]
    if axes is not None:
        u, v = u @ axes, v @ axes
    d = x.shape[1]
    slack = 1e-9

    def tails(z):
        sums = np.cumsum((z * z)[:, ::-1], axis=1)[:, ::-1]
        return np.sqrt(np.maximum(np.concatenate((sums, np.zeros((len(z), 1))), axis=1), 0))

    tu, tv = tails(u), tails(v)
    k = min(step, d)
    part = u[:, :k] @ v[:, :k].T
    i, j = np.nonzero(part + tu[:, k, None] * tv[None, :, k] >= threshold - slack)
    got = part[i, j]
    while k < d and len(i):
        m = min(k + step, d)
        out_i, out_j, out_g = [], [], []
        for a in range(0, len(i), 1 << 17):  # gathered rows stay within a few MB
            s = slice(a, a + (1 << 17))
            g = got[s] + np.einsum("nd,nd->n", u[i[s], k:m], v[j[s], k:m])
            ok = g + tu[i[s], m] * tv[j[s], m] >= threshold - slack
            out_i.append(i[s][ok])
            out_j.append(j[s][ok])
            out_g.append(g[ok])
        i, j, got, k = np.concatenate(out_i), np.concatenate(out_j), np.concatenate(out_g), m
    keep = [np.zeros(0, bool)]
    for a in range(0, len(i), 1 << 17):
        s = slice(a, a + (1 << 17))
        keep.append(np.einsum("nd,nd->n", x[i[s]], y[j[s]]) / (nx[i[s]] * ny[j[s]]) >= threshold)
    keep = np.concatenate(keep)
    return i[keep], j[keep]


def tile_links(reps: DataFrame, threshold: float, tile: int, axes: dict) -> DataFrame:
    """(id, n, to): links that a pair of tiles adds to a vector, and one linked vector of lower id or null."""
    sent = reps.sparkSession.sparkContext.broadcast(axes)
    sizes = reps.groupBy("label", "dim").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    dealt = reps.join(sizes, ["label", "dim"]).withColumn("t", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    pairs = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pairs = pairs.select("label", "dim", F.least("t", "o").alias("p"), F.greatest("t", "o").alias("q"), "t", "id", "mult", "embedding")

    def compare(key, group):
        p, q, d = key[2].as_py(), key[3].as_py(), key[1].as_py()
        t = group.column("t").to_numpy()
        ids, mult = group.column("id").to_numpy(), group.column("mult").to_numpy()
        x = np.asarray(group.column("embedding").combine_chunks().flatten().to_numpy(), np.float64).reshape(len(ids), d)
        left, right = np.flatnonzero(t == p), np.flatnonzero(t == q)
        none = pa.table({"id": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "to": pa.array([], pa.int64())})
        if not len(left) or not len(right):
            return none
        i, j = linked(x[left], x[right], sent.value.get(d), threshold)
        a, b = left[i], right[j]
        if p == q:
            a, b = a[a != b], b[a != b]  # both orders of each pair
            count = np.bincount(a, mult[b], len(ids))
        else:
            count = np.bincount(a, mult[b], len(ids)) + np.bincount(b, mult[a], len(ids))
        at = np.flatnonzero(count)
        if not len(at):
            return none
        nodes, least = C._roots(ids[a], ids[b])
        to = least[np.searchsorted(nodes, ids[at])]
        return pa.table({"id": pa.array(ids[at]), "n": pa.array(count[at].astype(np.int64)), "to": pa.array(to)})

    return pairs.groupBy("label", "dim", "p", "q").applyInArrow(compare, "id long, n long, to long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding, label)."""
    # Single precision is shuffled as such; only sums are taken in double.
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"), "label")
    good = rows.where(_valid())
    # Signs of zeros differ in bits only.
    plain = good.withColumn("embedding", F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0).cast(kind)).otherwise(x)))
    same = plain.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("mult"))
    reps = C.stored(same.select(F.monotonically_increasing_id().alias("id"), "label", "embedding", "least", "mult", F.size("embedding").alias("dim")))
    # Different vectors are nodes of their own.  Where each has a vec_id to itself, that is the node; else numbers are, and components are named after.
    shared = not reps.groupBy("least").count().where("count > 1").isEmpty()
    if not shared:
        reps = reps.withColumn("id", F.col("least"))
    axes = rotations(reps.select(F.col("least").alias("vec_id"), "embedding"))
    found = C.stored(tile_links(reps, threshold, tile, axes))
    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    named = C.components(found.select(F.col("to").alias("a"), F.col("id").alias("b")).where("a <> b")).withColumnRenamed("component_id", "name")
    if shared:
        names = named.join(reps.select("id", "least"), "id").groupBy("name").agg(F.min("least").alias("_least")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
        # A component of any size is looked up in sixteen tasks.
        named = named.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(16)).cast("int")).join(names, ["name", "_salt"]).select("id", F.col("_least").alias("name"))
    judged = reps.join(links, "id", "left").join(named, "id", "left").select("label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("name", "least").alias("component_id"))
    out = plain.join(judged, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = rows.where(~_valid()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector; odd rows as the module says."""
    return near_duplicates(C.table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


#: The same for DuckDB.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= CAST(0.93 AS DOUBLE)),
reach AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.c),
least AS (SELECT vec_id, min(c) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least.component_id, e.vec_id = least.component_id AS kept
FROM embeddings e JOIN least ON least.vec_id = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
