"""What the corpus operators share: reading, shared files, vectorised hashing of texts, components of links."""

from __future__ import annotations

import atexit
import ctypes
import functools
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomalign.sources.fasta import shared_dir

#: White space between words: \x20 and \x09 to \x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that Python works on at a time; NumPy needs some forty times as much memory.
CHUNK_BYTES = 1 << 19
#: Longer stretches are hashed by BLAKE2b: sums of powers collide on some regular strings of 1,024 bytes and more.
LONG_SPAN = 64

_ODD = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_ODD), -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Only the named columns of a table: others, whatever their names, are never read."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def bounded_batches(spark: SparkSession, size: str = "4m") -> None:
    """Batches that go to Python have a bound in bytes, since texts vary: by rows alone, 10,000 long ones go at once.

    A setting of the session, since Spark has no other place for it; it stays.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


_STORED: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again.  Later stages survive lost executors without this work."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    if not _STORED:
        atexit.register(_release_at_exit, spark)
    _STORED.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_paths() -> list[str]:
    """What this process has stored so far and not released."""
    return list(_STORED)


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete stored tables (all of this process by default): for when what was made from them is written."""
    for path in stored_paths() if paths is None else paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        if path in _STORED:
            _STORED.remove(path)


def _release_at_exit(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:  # a stopped context has none
        release(spark)


def give_back() -> None:
    """Return to the system what this process holds and no longer needs."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(run):
    """A function over batches that gives memory back at its end: idle workers would keep what their largest batch took.

    What the wrapper names must be importable: it is sent with the values of other names.
    """

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def label_side(column: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 4; rows with 2 are held out from every fit."""
    return F.crc32(F.col(column).cast("string")) % 4


# ---- Arrow batches as bytes -------------------------------------------------


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def small_batches(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of text (or one row) and at most ``rows`` rows."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        offsets = text_buffers(batch.column(column))[1]
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            end = min(max(end, start + 1), start + rows, batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def small_rows(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes, whatever their columns, or one row."""
    for batch in batches:
        step = max(1, batch.num_rows * limit // max(1, batch.nbytes))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, mod 2^64, of the hash's base and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        m = max(n, CHUNK_BYTES * 2)
        _POWERS[:] = [np.concatenate((np.ones(1, np.uint64), np.multiply.accumulate(np.full(m - 1, x, np.uint64)))) for x in (_ODD, _INV)]
    return _POWERS[0][:n], _POWERS[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any stretch of a byte array, each in a constant number of steps.  Equal ones need not mean equal bytes (see LONG_SPAN)."""

    def __init__(self, data: np.ndarray):
        self.up, down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * down[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.up[start])


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of stretches of a byte array; those of long ones are cryptographic."""
    out = Rolling(data).of(starts, ends)
    for k in np.flatnonzero(ends - starts > LONG_SPAN).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8).digest(), "little")
    return out


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of BLAKE2b of every stretch, as two arrays of signed numbers: where equal digests stand for equal bytes."""
    raw, blake = memoryview(np.ascontiguousarray(data)), hashlib.blake2b
    joined = b"".join([blake(raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    pair = np.frombuffer(joined, np.int64).reshape(-1, 2)
    return pair[:, 0].copy(), pair[:, 1].copy()


def text_key(column: str = "text") -> tuple[Column, Column]:
    """(ka, kb): two hashes of a text under different seeds, which name it wherever rows of equal text are alike."""
    text = F.coalesce(F.col(column), F.lit(""))
    return F.xxhash64(F.lit(1), text).alias("ka"), F.xxhash64(F.lit(2), text).alias("kb")


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of every text: (starts, ends, first word of each text, with the count at the end)."""
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = ~_SPACE[data]
    bound = np.zeros(n + 1, bool)
    bound[offsets] = True
    before = np.zeros(n + 1, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | bound))
    ends = np.flatnonzero(before & (~inside | bound))
    return starts, ends, np.searchsorted(starts, offsets)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def windows(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every window of ``width`` items and each text's first window.  A shorter, not empty text is one window."""
    n = len(hashes)
    odd = mixed(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < width))
    sums = np.zeros(n, np.uint64)
    if n >= width:
        for t in range(width):
            sums[: n - width + 1] += hashes[t : n - width + 1 + t] * odd[t]
    use = np.zeros(n, bool)
    full = np.flatnonzero(count >= width)
    if len(full):
        step = np.zeros(n + 1, np.int64)
        np.add.at(step, first[full], 1)
        np.add.at(step, first[full + 1] - width + 1, -1)
        use = np.cumsum(step[:n]) > 0
    for d in short:
        at, k = first[d], int(count[d])
        sums[at] = (hashes[at : at + k] * odd[:k]).sum(dtype=np.uint64) + np.uint64(k)
        use[at] = True
    places = np.flatnonzero(use)
    return mixed(sums[places]), np.searchsorted(places, first)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def lists(values: pa.Array, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


# ---- fixed-size tables of counts, summed over all partitions ------------------


def summed_table(df: DataFrame, cells_of, cells: int, planes: int = 16, finish=lambda sums: sums) -> np.ndarray:
    """Counts over all rows in a table of fixed size; ``cells_of(batch)`` gives the cells that a batch touches.

    Each task sends its table in ``planes`` parts, each part is summed in two
    levels as it comes by, and only what ``finish`` makes of the sums, of a size
    that does not depend on the data, comes to the driver.
    """
    width = cells // planes

    @tidy
    def count(batches):
        out = np.zeros(cells, np.uint32)
        for batch in batches:
            out += np.bincount(cells_of(batch), minlength=cells).astype(np.uint32)
        # Bytes of equal weight lie together: most are zero and shrink to nothing in the shuffle.
        parts = [out[i * width : (i + 1) * width].view(np.uint8).reshape(-1, 4).T.tobytes() for i in range(planes)]
        yield pa.RecordBatch.from_arrays([pa.array(range(planes), pa.int32()), pa.array(parts, pa.binary())], ["part", "table"])

    def adding(last):
        @tidy
        def add(batches):
            """Sums of the tables that come by, one for each part: memory does not depend on their number."""
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for part, blob, level in zip(batch.column("part").to_pylist(), batch.column("table"), batch.column("level").to_pylist(), strict=True):
                    x = np.frombuffer(blob.as_py(), np.uint8)
                    x = x.view(np.uint64) if level else np.ascontiguousarray(x.reshape(4, -1).T).view(np.uint32).ravel()
                    sums[part] = sums[part] + x if part in sums else x.astype(np.uint64)
            blobs = [(finish(t) if last else t).tobytes() for t in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(blobs, pa.binary()), pa.array([1] * len(sums), pa.int32())], ["part", "table", "level"])

        return add

    schema = "part int, table binary, level int"
    tables = df.mapInArrow(count, "part int, table binary").withColumn("level", F.lit(0))
    # Two levels: a part's tables are first summed in up to 64 tasks.
    tables = tables.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64))).repartition("part", "salt").drop("salt").mapInArrow(adding(False), schema)
    parts = {r.part: r.table for r in tables.repartition(planes, "part").mapInArrow(adding(True), schema).collect()}
    empty = finish(np.zeros(width, np.uint64))
    return np.concatenate([np.frombuffer(parts[i], empty.dtype) if i in parts else empty for i in range(planes)])


# ---- connected components ----------------------------------------------------


def _roots(a: np.ndarray, b: np.ndarray, salt: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of the edges at hand, by union-find.  With a salt, the one of least salted hash."""
    nodes, index = np.unique(np.concatenate((a, b)), return_inverse=True)
    if salt is not None:
        order = np.argsort(mixed(nodes.astype(np.int64).view(np.uint64) ^ mixed(np.array([salt], np.uint64))))
        place = np.empty(len(nodes), np.int64)
        place[order] = np.arange(len(nodes))
        nodes, index = nodes[order], place[index]
    parent = list(range(len(nodes)))
    for x, y in zip(index[: len(a)].tolist(), index[len(a) :].tolist(), strict=True):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    for i, p in enumerate(parent):
        parent[i] = parent[p]
    return nodes, nodes[np.array(parent, np.int64)] if len(nodes) else nodes


def forest(edges: DataFrame, salt: int | None = None, whole: bool = False, held: int = 1_000_000) -> DataFrame:
    """The links of each partition as stars (centre, node): connectivity stays, and no more rows than nodes.

    A partition is taken in blocks of ``held`` links, each with what the blocks
    before left.  whole: with a row for each centre itself.
    """

    @tidy
    def reduce(batches):
        a, b, size = [], [], 0

        def out():
            nodes, least = _roots(np.concatenate(a), np.concatenate(b), salt)
            keep = nodes != least
            return least[keep], nodes[keep]

        def table(x, y):
            if whole:
                own = np.unique(x)
                x, y = np.concatenate((x, own)), np.concatenate((y, own))
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

        for batch in batches:
            a.append(batch.column(0).to_numpy())
            b.append(batch.column(1).to_numpy())
            size += batch.num_rows
            if size > held:
                x, y = out()
                if len(x) > size // 2:  # not worth holding on to
                    yield table(x, y)
                    x, y = x[:0], y[:0]
                a, b, size = [x], [y], len(x)
        if size:
            yield table(*out())

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(reduce, "a long, b long")


def components(edges: DataFrame, task_links: int = 1 << 19, max_rounds: int = 80) -> DataFrame:
    """(id, component_id): every node of the links (a, b) with the least node that it can reach.

    Rounds of contraction.  Links are dealt to tasks by hash, about
    ``task_links`` to each; a task turns its own into stars around the nodes of
    least salted hash.  A node then has one centre for each task that saw it, so
    a hub is as many rows as tasks, however many neighbours it has.  It goes to
    one of its centres, and links between its centres alone are the next round's
    graph.  In the worst case, a path, a third of the nodes go in each round; links that fit
    one task are done in one.  Centres are then followed back, and each
    component takes its least node.  Only counts come to the driver.
    """
    spark = edges.sparkSession
    current = stored(forest(edges.where("a <> b")))
    steps = []
    for salt in range(max_rounds):
        n = current.count()
        if not n:
            break
        tasks = -(-n // task_links)
        dealt = current.coalesce(1) if tasks == 1 else current.repartition(tasks, F.xxhash64("a", "b", F.lit(salt)))
        stars = forest(dealt, salt, True, max(2 * task_links, 1_000_000)).select(F.col("b").alias("id"), F.col("a").alias("centre"))
        if tasks == 1:
            steps.append(stored(stars))
            break
        seen = stored(stars.groupBy("id").agg(F.collect_set("centre").alias("centres")).withColumn("centre", F.array_min("centres")))
        steps.append(seen.select("id", "centre"))
        current = stored(forest(seen.select(F.col("centre").alias("a"), F.explode("centres").alias("b")).where("a <> b")))
    else:
        raise RuntimeError("the components did not settle")
    if not steps:
        return spark.createDataFrame([], "id long, component_id long")
    found = steps.pop()
    while steps:
        later = found.select(F.col("id").alias("centre"), F.col("centre").alias("root"))
        found = stored(steps.pop().join(later, "centre", "left").select("id", F.coalesce("root", "centre").alias("centre")))
    least = stored(found.groupBy("centre").agg(F.min("id").alias("component_id")))
    return found.join(least, "centre").select("id", "component_id")


# ---- filters of fixed size for what a join can drop beforehand -----------------


def key_filter(keys: DataFrame, bits: int = 23) -> np.ndarray:
    """A table of 2^bits bits with those of the (long) keys set: a filter of one hash, of a size that the data cannot change.

    It only thins out a join's larger side; where the keys fill it, all rows pass and the join decides.
    """
    cells = 1 << bits

    def collect(batches):
        out = np.zeros(cells, bool)
        for batch in batches:
            out[_cell(batch.column(0).to_numpy(), bits)] = True
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([np.packbits(out).tobytes()], pa.binary())], ["part", "table"])

    def merge(batches):
        out = None
        for batch in batches:
            for blob in batch.column("table"):
                x = np.frombuffer(blob.as_py(), np.uint8)
                out = x if out is None else out | x
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["part", "table"])

    schema = "part int, table binary"
    tables = keys.mapInArrow(collect, schema)
    # A tree: the tables of a few tasks meet in one, so that no task gets those of all.
    tables = tables.repartition(max(1, min(4, partitions(keys.sparkSession) // 4))).mapInArrow(merge, schema)
    out = np.zeros(cells // 8, np.uint8)
    for row in tables.collect():
        out |= np.frombuffer(row.table, np.uint8)
    return out


def _cell(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(keys.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def may_have(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    cell = _cell(np.ascontiguousarray(keys), int(len(table) * 8).bit_length() - 1)
    return (table[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1


def thinned(df: DataFrame, column: str, table: np.ndarray, hits: bool = True) -> DataFrame:
    """The rows whose key the filter may have; or, without ``hits``, those that it surely has not."""
    sent = df.sparkSession.sparkContext.broadcast(table)

    @tidy
    def run(batches):
        for batch in batches:
            ok = may_have(sent.value, batch.column(column).to_numpy()) == hits
            yield batch.filter(pa.array(ok))

    return df.mapInArrow(run, df.schema)


# ---- texts by their own key -------------------------------------------------------

#: Keys that a task remembers at a time.
_REMEMBERED = 200_000


def keyed(docs: DataFrame) -> DataFrame:
    """(ka, kb, text) of every row; a null is empty."""
    return docs.select(*text_key(), F.coalesce("text", F.lit("")).alias("text"))


def one_each(texts: DataFrame) -> DataFrame:
    """Every text of keyed ones once: by task first, so that copies do not meet."""

    @tidy
    def run(batches):
        seen = set()
        for batch in batches:
            fresh = []
            for i, key in enumerate(zip(batch.column("ka").to_pylist(), batch.column("kb").to_pylist(), strict=True)):
                if key not in seen:
                    seen.add(key)
                    fresh.append(i)
            yield batch.take(pa.array(fresh, pa.int64()))
            if len(seen) > _REMEMBERED:
                seen.clear()

    return texts.mapInArrow(run, texts.schema).dropDuplicates(["ka", "kb"])


# ---- labelled samples -----------------------------------------------------------


def labelled_rows(spark: SparkSession, sf_dir: str, label: str, each: int, max_chars: int = 50_000) -> DataFrame:
    """(doc_id, text, y) of up to ``each`` labelled documents of either class, none of them held out.

    The rows are those of the least hashes of the id, so reruns agree.  Ids are
    chosen from ``labels`` alone; only the chosen ones, of a bounded number and
    length, meet their texts.  Texts over ``max_chars`` are not learned from.
    """
    labels = table(spark, sf_dir, "labels", "doc_id", label).where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (label_side() != 2))
    picked = None
    for value in (0, 1):
        part = labels.where(F.col(label) == value).groupBy("doc_id").agg(F.max(label).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each)
        picked = part if picked is None else picked.union(part)
    docs = table(spark, sf_dir, "documents", "doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    return docs.join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id", "y"])  # 2 * each rows at most


def labelled_sample(spark: SparkSession, sf_dir: str, label: str, each: int):
    """(texts, labels) of ``labelled_rows`` on the driver."""
    rows = sorted(labelled_rows(spark, sf_dir, label, each).collect(), key=lambda r: (r.doc_id, r.y))
    return [r.text for r in rows], np.array([r.y for r in rows], np.int64)


def fitted(rows: DataFrame, fit):
    """fit(texts, labels) of the bounded rows, computed in one task: the driver gets the model alone."""

    def run(batches):
        texts, y = [], []
        for batch in batches:
            texts += batch.column("text").to_pylist()
            y += batch.column("y").to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([cloudpickle.dumps(fit(texts, np.array(y, np.int64)))], pa.binary())], ["model"])

    one = rows.select("doc_id", "text", "y").repartition(1).sortWithinPartitions("doc_id", "y")
    row = one.mapInArrow(run, "model binary").first()
    return cloudpickle.loads(row.model) if row else fit([], np.zeros(0, np.int64))  # no rows: no task
