"""Approximate nearest neighbours by cross-polytope hashing with multiprobe, candidates reranked exactly.

A unit vector, padded to a power of two, goes through three rounds of random
signs and a Hadamard transform, each d log d additions (a pseudo-rotation), and
is hashed to the nearest signed axis.  A table joins so many of these functions
(the last one on fewer coordinates) that a bucket holds some ``BUCKET`` vectors
of a table of n.  A query probes each table's buckets in order of how near their
axes are, and all vectors of a probed bucket are compared by the exact distance.

How many buckets a query probes is not a constant: up to ``SAMPLE`` queries (those
of least hash; the only thing fitted on a sample) are answered exactly in one
pass, and what share of their neighbours lies in the first t probed buckets of
some table is known for every t.  The least t that finds ``RECALL`` of them is
used; where that is above ``PROBES``, a table has coarser buckets, down to one
bucket, which is the exact search.  So recall holds at every size and for every
kind of data, and what grows is the work.

Equal vectors are one vector with the ids of its copies (the few least ones that
any answer can need, by a partial top-n), so a group of copies of any size is one
row.  A bucket is compared in tiles of bounded size, rows and queries both split,
so a bucket with a third of all rows is many tasks, and a tile sends on only what
can be among the nearest.  Queries that found fewer than they must (their buckets
were nearly empty) are compared with all rows in tiles of the same kind.

Vectors that are null, empty, zero or hold null or non-finite components, and
rows without vec_id, take no part.  Vectors of different length are never near
each other.  Distances are those of the vectors as given, in double precision,
ties go to the smaller vec_id.  Only a query's own row is left out: repeated rows
and rows of the same vec_id are candidates, each repeated query gets its answer.
With fewer candidates than asked for, all come.  An empty table, or one without
queries, gives no rows.  Further columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

NEAREST = 10
TABLES = 4
#: Vectors that a bucket should hold; buckets that a query may probe in each table.
BUCKET, PROBES = 512, 64
SAMPLE, RECALL = 256, 0.95
#: Components of the vectors of a tile, rows of it and queries of it.
TILE_CELLS, TILE_ROWS, TILE_QUERIES = 1 << 19, 8192, 2048
#: Queries and rows that are compared at a time, bounding a matrix of distances.
_BLOCK = 1 << 20


# ---- hashing ------------------------------------------------------------------


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal fast Hadamard transform of every row; the number of columns is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        pairs = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotated(x: np.ndarray, table: int, function: int) -> np.ndarray:
    """A pseudo-rotation of unit vectors: signs and transform, three times."""
    d = x.shape[1]
    wide = 1 << max(0, (d - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, wide - d))) if wide > d else x
    r = np.random.default_rng((11, table, function, wide))
    for _ in range(3):
        x = hadamard(x * r.choice(np.array([-1.0, 1.0]), wide))
    return x


def axes_of(bits: int, d: int) -> list[int]:
    """How many axes each function of a table uses: 2^bits buckets in all, at most 2 d (padded) to a function."""
    full = max(0, (d - 1).bit_length()) + 1
    out = [1 << (full - 1)] * (bits // full)
    return [*out, 1 << (bits % full - 1)] if bits % full else out


def _sides(x: np.ndarray, table: int, bits: int):
    """For each function of a table: how far each row lies along each of its signed axes."""
    for f, axes in enumerate(axes_of(bits, x.shape[1])):
        y = rotated(x, table, f)[:, :axes]
        yield np.concatenate((y, -y), axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows over their norms, also where squares would leave the range of doubles."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def buckets(x: np.ndarray, table: int, bits: int) -> np.ndarray:
    """The bucket of every unit vector in a table of 2^bits buckets."""
    out = np.zeros(len(x), np.int64)
    for side in _sides(x, table, bits):
        out = out * side.shape[1] + np.argmax(side, axis=1)
    return out


def probes(x: np.ndarray, table: int, bits: int, count: int) -> np.ndarray:
    """The first ``count`` buckets of every unit vector, nearest axes first: (rows, at most count)."""
    best, codes = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
    for side in _sides(x, table, bits):
        k = min(count, side.shape[1])
        top = np.argsort(-side, axis=1, kind="stable")[:, :k]
        score = (best[:, :, None] + np.take_along_axis(side, top, 1)[:, None, :]).reshape(len(x), -1)
        code = (codes[:, :, None] * side.shape[1] + top[:, None, :]).reshape(len(x), -1)
        # Of a sum's best, each part is among the best of its own: nothing else can be needed.
        order = np.argsort(-score, axis=1, kind="stable")[:, :count]
        best, codes = np.take_along_axis(score, order, 1), np.take_along_axis(code, order, 1)
    return codes


# ---- exact comparison ------------------------------------------------------------


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of pairs of rows."""
    d = q - x
    return np.sqrt((d * d).sum(axis=1))


def nearest(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, row, distance) of the k rows nearest to each query but itself; of equal ones those of smaller ``least``."""
    out_q, out_x, out_d = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    # Products only choose; what they may be wrong by is allowed for, and the distances are taken anew.
    scale = max(float(np.abs(x).max(initial=0)), float(np.abs(q).max(initial=0)), np.finfo(float).tiny)
    y, p = x / scale, q / scale
    norms = (y * y).sum(axis=1)
    step = max(1, _BLOCK // max(1, len(x)))
    for a in range(0, len(q), step):
        part = p[a : a + step]
        rough = norms[None, :] - 2 * part @ y.T
        rough[qid[a : a + step, None] == xid[None, :]] = np.inf
        if len(x) > k:
            cut = np.partition(rough, k - 1, axis=1)[:, k - 1 : k]
            slack = 1e-12 * x.shape[1] * (1 + float(norms.max()))
            i, j = np.nonzero((rough <= cut + slack) & np.isfinite(rough))
        else:
            i, j = np.nonzero(np.isfinite(rough))
        d = distances(q[a + i], x[j])
        order = np.lexsort((xid[j], least[j], d, i))
        i, j, d = i[order], j[order], d[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        keep = rank < k
        out_q.append(a + i[keep])
        out_x.append(j[keep])
        out_d.append(d[keep])
    return np.concatenate(out_q), np.concatenate(out_x), np.concatenate(out_d)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, d)


def _by_length(batches, rows: int = 4096):
    """Batches whose vectors have one length, with that length."""
    for batch in batches:
        sizes = batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
        for d in np.unique(sizes).tolist():
            part = batch.filter(pa.array(sizes == d))
            step = max(1, min(rows, TILE_CELLS // d))
            for a in range(0, part.num_rows, step):
                yield d, part.slice(a, step)


_FOUND = "q long, v long, least long, d double"


def _answers(q, v, least, d) -> pa.Table:
    return pa.table({"q": pa.array(q, pa.int64()), "v": pa.array(v, pa.int64()), "least": pa.array(least, pa.int64()), "d": pa.array(d, pa.float64())})


def merged(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of what tiles found; a vector that several tables found counts once.  Every task first keeps its own k."""
    one = found.groupBy("q", "v").agg(F.first("least").alias("least"), F.first("d").alias("d"))
    order = Window.partitionBy("q").orderBy("d", "least", "v")
    return one.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank")


def tiled(rows: DataFrame, asked: DataFrame, keys: list[str], k: int) -> DataFrame:
    """``_FOUND``: the k nearest rows of its bucket for every query, bucket by bucket in tiles.

    rows and asked: (*keys, rid, least, embedding), where a bucket is all that
    has one value of the keys, of which ``dim`` is the vectors' length.
    """
    cells = F.greatest(F.lit(16), F.lit(TILE_CELLS) / F.col("dim"))
    parts = lambda n, most: F.ceil(F.col(n) / F.least(cells, F.lit(most))).cast("int")
    have, want = rows.groupBy(*keys).agg(F.count("*").alias("_n")), asked.groupBy(*keys).agg(F.count("*").alias("_m"))
    sizes = have.join(want, keys).select(*keys, parts("_n", TILE_ROWS).alias("rows"), parts("_m", TILE_QUERIES).alias("queries"))
    sizes = C.stored(sizes)
    spread = lambda own, other, flag: (
        (rows if flag == 0 else asked)
        .join(sizes, keys)
        .withColumn("_own", F.pmod(F.xxhash64("rid"), F.col(own)).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        .select(*keys, F.col("_own" if flag == 0 else "_other").alias("_r"), F.col("_other" if flag == 0 else "_own").alias("_q"), F.lit(flag).alias("_asks"), "rid", "least", "embedding")
    )
    both = spread("rows", "queries", 0).unionByName(spread("queries", "rows", 1))
    dim = keys.index("dim")

    def compare(key, tile):
        d = key[dim].as_py()
        asks = tile.column("_asks").to_numpy() == 1
        x, rid, least = _matrix(tile.column("embedding"), d), tile.column("rid").to_numpy(), tile.column("least").to_numpy()
        q, r = np.flatnonzero(asks), np.flatnonzero(~asks)
        if not len(q) or not len(r):
            return _answers([], [], [], [])
        i, j, dist = nearest(x[q], rid[q], x[r], rid[r], least[r], k)
        return _answers(rid[q][i], rid[r][j], least[r][j], dist)

    return both.groupBy(*keys, "_r", "_q").applyInArrow(compare, _FOUND)


# ---- the search -----------------------------------------------------------------


def _usable():
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))


def _distinct(good: DataFrame, k: int, asks) -> tuple[DataFrame, DataFrame]:
    """(vectors (rid, dim, least, ids, asks, ka, kb, embedding), query rows (vec_id, ka, kb)): every different vector once."""
    keyed = good.select("vec_id", F.xxhash64(F.lit(1), "embedding").alias("ka"), F.xxhash64(F.lit(2), "embedding").alias("kb"), "embedding")
    queries = keyed.where(asks).select("vec_id", "ka", "kb")
    # The k + 1 least ids: an answer has k, and one may be the query's own.
    order = Window.partitionBy("ka", "kb").orderBy("vec_id")
    few = keyed.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k + 1)
    one = few.groupBy("ka", "kb").agg(F.first("embedding").alias("embedding"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    who = queries.select("ka", "kb").distinct().withColumn("asks", F.lit(True))
    rows = one.join(who, ["ka", "kb"], "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    rows = rows.select(F.monotonically_increasing_id().alias("rid"), F.size("embedding").alias("dim"), F.col("ids")[0].alias("least"), "ids", "asks", "ka", "kb", "embedding")
    return C.stored(rows), queries


def exact(rows: DataFrame, asked: list, k: int) -> dict[int, list[int]]:
    """rids of the k vectors nearest to each of a bounded number of queries, by one pass over all vectors."""
    by: dict[int, tuple] = {}
    for d in {r.dim for r in asked}:
        some = [r for r in asked if r.dim == d]
        by[d] = np.array([r.embedding for r in some], np.float64), np.array([r.rid for r in some], np.int64)
    sent = rows.sparkSession.sparkContext.broadcast(by)

    @C.tidy
    def run(batches):
        best: dict[int, tuple] = {}
        for d, batch in _by_length(batches):
            if d not in sent.value:
                continue
            q, qid = sent.value[d]
            rid, least = batch.column("rid").to_numpy(), batch.column("least").to_numpy()
            i, j, dist = nearest(q, qid, _matrix(batch.column("embedding"), d), rid, least, k)
            new = [qid[i], rid[j], least[j], dist]
            old = best.get(d)
            new = [np.concatenate((a, b)) for a, b in zip(old, new, strict=True)] if old else new
            order = np.lexsort((new[1], new[2], new[3], new[0]))
            new = [a[order] for a in new]
            keep = np.arange(len(order)) - np.searchsorted(new[0], new[0]) < k
            best[d] = tuple(a[keep] for a in new)
        for q, v, least, dist in best.values():
            yield from _answers(q, v, least, dist).to_batches()

    found: dict[int, list[int]] = {}
    for r in merged(rows.select("rid", "least", "embedding").mapInArrow(run, _FOUND), k).select("q", "v").collect():
        found.setdefault(r.q, []).append(r.v)
    sent.unpersist()
    return found


def settings(rows: DataFrame, k: int = NEAREST, tables: int = TABLES, sample: int = SAMPLE, recall: float = RECALL, bucket: int = BUCKET, most: int = PROBES) -> dict[int, tuple[int, int, float]]:
    """By vector length: (bits of a table, buckets that a query probes in each, share of the sample's neighbours found)."""
    counts = {r.dim: r.n for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.max("asks").alias("asks")).where("asks").collect()}
    order = Window.partitionBy("dim").orderBy("ka", "kb")
    asked = rows.where("asks").withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= sample).select("rid", "dim", "embedding").collect()
    truth = exact(rows, asked, k) if asked else {}
    ids = sorted({v for vs in truth.values() for v in vs})
    spark = rows.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(i,) for i in ids], "rid long"))
    vectors = {r.rid: r.embedding for r in rows.select("rid", "embedding").join(wanted, "rid").collect()}
    out = {}
    for d, n in counts.items():
        some = [r for r in asked if r.dim == d and truth.get(r.rid)]
        bits = max(0, (n // bucket).bit_length() - 1)
        if not some:
            out[d] = 0, 1, 1.0
            continue
        q = unit(np.array([r.embedding for r in some], np.float64))
        near = [unit(np.array([vectors[v] for v in truth[r.rid]], np.float64)) for r in some]
        first = np.cumsum([0, *map(len, near)])
        flat = np.concatenate(near)
        owner = np.repeat(np.arange(len(some)), np.diff(first))
        while True:
            # In how many probes each neighbour is found, by the table that finds it first.
            rank = np.full(len(flat), most, np.int64)
            for t in range(tables):
                hit = probes(q, t, bits, most)[owner] == buckets(flat, t, bits)[:, None]
                rank = np.minimum(rank, np.where(hit.any(axis=1), hit.argmax(axis=1), most))
            share = np.cumsum(np.bincount(rank, minlength=most + 1)[:most]) / len(flat)
            enough = np.flatnonzero(share >= recall)
            if len(enough):
                out[d] = bits, int(enough[0]) + 1, float(share[enough[0]])
                break
            bits -= 1  # at no bits one bucket holds everything
    return out


def neighbours(rows: DataFrame, k: int = NEAREST, tables: int = TABLES, chosen: dict[int, tuple] | None = None) -> DataFrame:
    """(q, v, d): for each vector that asks, the k nearest other ones found; exact where tables find too few."""
    chosen = settings(rows, k, tables) if chosen is None else chosen

    def entries(asking):
        @C.tidy
        def run(batches):
            for d, batch in _by_length(batches):
                if d not in chosen:
                    continue
                bits, count, _ = chosen[d]
                x = unit(_matrix(batch.column("embedding"), d))
                # Without bits, one table's one bucket is all.
                for t in range(tables if bits else 1):
                    codes = probes(x, t, bits, count) if asking else buckets(x, t, bits)[:, None]
                    each = pa.array(np.repeat(np.arange(len(x)), codes.shape[1]))
                    for a in range(0, len(each), 4096):
                        at = each.slice(a, 4096)
                        m = len(at)
                        columns = [pa.array([d] * m, pa.int32()), pa.array([t] * m, pa.int32()), pa.array(codes.ravel()[a : a + 4096]), *(batch.column(c).take(at) for c in ("rid", "least", "embedding"))]
                        yield pa.RecordBatch.from_arrays(columns, ["dim", "tab", "bucket", "rid", "least", "embedding"])

        kind = rows.schema["embedding"].dataType.simpleString()
        return run, f"dim int, tab int, bucket long, rid long, least long, embedding {kind}"

    plain = rows.select("rid", "least", "embedding")
    table = plain.mapInArrow(*entries(False))
    asked = rows.where("asks").select("rid", "least", "embedding").mapInArrow(*entries(True))
    found = C.stored(merged(tiled(table, asked, ["dim", "tab", "bucket"], k), k))
    sizes = rows.groupBy("dim").agg((F.count("*") - 1).alias("others"))
    got = found.groupBy(F.col("q").alias("rid")).agg(F.count("*").alias("got"))
    short = rows.where("asks").join(sizes, "dim").join(got, "rid", "left").where(F.coalesce("got", F.lit(0)) < F.least(F.lit(k), F.col("others")))
    short = C.stored(short.select("dim", "rid", "least", "embedding"))
    if not short.isEmpty():
        rest = merged(tiled(rows.select("dim", "rid", "least", "embedding"), short, ["dim"], k), k)
        found = found.join(short.select(F.col("rid").alias("q")), "q", "left_anti").unionByName(rest)
    return found.select("q", "v", "d")


def search(vectors: DataFrame, asks=None, k: int = NEAREST, **options) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that ``asks`` (of vec_id), its k nearest others of vectors (vec_id, embedding)."""
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding")).where(_usable())
    # Signs of zeros differ in bits only.
    plain = rows.withColumn("embedding", F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0).cast(kind)).otherwise(x)))
    known, queries = _distinct(plain, k, F.lit(True) if asks is None else asks)
    found = neighbours(known, k, **options)
    copies = known.select(F.col("rid").alias("v"), "ids")
    # At most k times k + 1 numbers to a query from here on.
    near = found.join(copies, "v").select("q", F.transform("ids", lambda i: F.struct(F.col("d").alias("d"), i.alias("id"))).alias("c"))
    near = near.groupBy(F.col("q").alias("rid")).agg(F.flatten(F.collect_list("c")).alias("near"))
    own = known.where("asks").select("rid", "ka", "kb", "ids").join(near, "rid", "left")
    mine = F.array_position("ids", F.col("vec_id")) - 1
    others = F.filter("ids", lambda _, i: i != mine)
    same = F.transform(others, lambda i: F.struct(F.lit(0.0).alias("d"), i.alias("id")))
    best = F.slice(F.array_sort(F.concat(same, F.coalesce("near", F.array().cast("array<struct<d:double,id:bigint>>")))), 1, k)
    out = queries.join(own, ["ka", "kb"]).select(F.col("vec_id").alias("query_id"), F.posexplode(best).alias("rank", "c"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("c.id").alias("vec_id"), F.col("c.d").alias("score"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, rank, vec_id, score) for every row whose vec_id is divisible by 100, against all rows; odd rows as the module says."""
    return search(C.table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 100 == 0)
