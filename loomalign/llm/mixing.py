"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Each source's documents, in an order shuffled by hash, form a line of words that
is cut into blocks of equal size.  Slots 0, 1, 2, ... take the golden-ratio
points frac(i * 0.618...), mapped through the sources' cumulative expected slots;
the r-th slot of a source takes its r-th block, beginning again after the last.
Every stretch of the schedule so holds each source close to its share.

Whole slots cannot give a source of few blocks its share: it may be taken once
instead of twice, or not at all.  Sources that the schedule misses by more than
``MISS`` of their target are settled after it: whole rounds of the source, and
once more the words at the beginning of its line, to the exact word.

The number of slots is a parameter and not a matter of size: a larger corpus has
larger blocks.  Positions in a source's line are sums over 4096 salted parts of
the source and then within the part, and ranks of slots and sums over blocks are
taken in stretches of ``CHUNK`` first, so a source with a third of all rows is no
single task's work.  The tables of sources, slots and blocks have at most as
many rows as sources plus ``resolution``.

Null texts, empty texts and texts without words have size 0 and are never taken.
Very long texts are counted whole and can be taken in part.  A null source is a
source of its own, the last.  Rows with equal ids, repeated or not, are rows of
their own; rows without doc_id are too.  Ties: equal hashes are ordered by
doc_id and size, and rows equal in all of these are interchangeable.  Reruns
give equal results: nothing depends on the order of partitions.  An empty table
gives no rows.  Further columns, whatever their names, are not read (``drawn``
passes them on).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

RESOLUTION = 65536
#: Bytes of facts of sources up to which all tasks get them.
SENT_BYTES = 1 << 23
#: Rows of a source that are ranked or summed in one group.
CHUNK = 1024
MIN_BLOCK = 16
GOLDEN = 0.6180339887498949
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Of a source's target: the schedule's miss beyond which the source is settled by rounds of its line.
MISS = 0.01


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, skey, size, h, part): the source as a key without nulls, words, and place in the shuffled order."""
    h = F.md5(F.concat(F.lit("mix"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    return docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("t")).alias("skey"),
        F.coalesce(F.regexp_count("text", F.lit(C.WORD)), F.lit(0)).cast("long").alias("size"),
        h.alias("h"),
        F.substring(h, 1, 3).alias("part"),
    )


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(skey, s, target): sources with their size and their words in the mix.

    Weights repeat in code point order.  Sources whose limit, per weight, is
    below what the others get are held at it, the least first; the rest share
    what is left by weight.
    """
    total = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", "skey")
    s = sizes.groupBy("skey").agg(F.sum("size").alias("s"))
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy("skey")) - 1) % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("ratio", F.col("s").cast("double") * most / F.col("w"))
    s = s.withColumn("all_s", F.sum("s").over(total)).withColumn("all_w", F.sum("w").over(total))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("held", F.coalesce(F.sum("s").over(before), F.lit(0)) * most).withColumn("gone", F.coalesce(F.sum("w").over(before), F.lit(0)))
    level = (F.col("all_s") * F.lit(share) - F.col("held")) / (F.col("all_w") - F.col("gone"))
    s = s.withColumn("capped", F.col("ratio") <= level)
    # The limits hold for a first stretch in this order; sums over it give the level of the rest.
    held = F.sum(F.when(F.col("capped"), F.col("s") * most).otherwise(0)).over(total)
    open_w = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("w"))).over(total)
    s = s.withColumn("target", F.when(F.col("capped"), (F.col("s") * most).cast("double")).otherwise((F.col("all_s") * F.lit(share) - held) * F.col("w") / open_w))
    return s.select("skey", "s", "target", "all_s")


def plan(sources: DataFrame, resolution: int = RESOLUTION, share: float = SHARE) -> DataFrame:
    """Adds nb (blocks of the source), lo and hi (its stretch of the unit interval) and slots (of the whole schedule)."""
    block = F.greatest(F.lit(float(MIN_BLOCK)), F.col("all_s") * F.lit(share) / F.lit(float(resolution)))
    p = sources.where("s > 0").withColumn("nb", F.greatest(F.lit(1), F.floor(F.col("s") / block + 0.5)).cast("long"))
    p = p.withColumn("e", F.col("target") * F.col("nb") / F.col("s"))
    # Expected slots in parts of a millionth: sums of integers do not depend on their order.
    p = p.withColumn("e", F.floor(F.col("e") * 1000000 + 0.5).cast("long")).where("e > 0")
    order = Window.orderBy("skey").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("top", F.sum("e").over(order)).withColumn("all_e", F.sum("e").over(Window.partitionBy()))
    p = p.withColumn("lo", (F.col("top") - F.col("e")).cast("double") / F.col("all_e")).withColumn("hi", F.col("top").cast("double") / F.col("all_e"))
    return p.withColumn("slots", F.floor(F.col("all_e") / 1000000.0 + 0.5).cast("long"))


def _running(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over a source's rows before each in ``order`` (whole numbers): by stretches, then within them."""
    df = df.withColumn("_c", F.floor(F.col(order) / CHUNK))
    before = Window.partitionBy("skey").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy("skey", "_c").agg(F.sum(value).alias("_s"))
    sums = sums.select("skey", "_c", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy("skey", "_c").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0))).join(sums, ["skey", "_c"])
    return out.withColumn(name, F.col("_base") + F.col("_in")).drop("_c", "_base", "_in")


def schedule(spark: SparkSession, planned: DataFrame, most: int = MOST) -> DataFrame:
    """(slot, skey, r, block): slots in order, their source, their rank in it and the block they take.

    Slots past ``most`` rounds of a source's blocks stay empty and are left out.
    """
    cells = 4096  # of the unit interval: points and stretches meet on equal cells, not by comparing all with all
    n = planned.agg(F.coalesce(F.max("slots"), F.lit(0)).alias("n"))
    # In two steps, so that no row holds all slots.
    c = n.select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"n div {CHUNK}"))).alias("c")).where(F.col("c") * CHUNK < F.col("n"))
    i = c.select(F.explode(F.sequence(F.col("c") * CHUNK, F.least("n", (F.col("c") + 1) * CHUNK) - 1)).alias("slot"))
    x = F.col("slot").cast("double") * F.lit(GOLDEN)
    i = i.withColumn("x", x - F.floor(x)).withColumn("cell", F.floor(F.col("x") * cells))
    last = F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1))
    p = planned.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), last)))
    got = i.join(p, "cell").where("x >= lo and x < hi")
    got = _running(got.withColumn("one", F.lit(1)), "slot", "one", "r")
    return got.where(F.col("r") < F.col("nb") * most).select("slot", "skey", "r", F.pmod("r", "nb").alias("block"))


def settled(sources: DataFrame, blocks: DataFrame, miss: float = MISS) -> DataFrame:
    """(skey, rounds, rest) of the sources that the schedule misses: how often all words are taken, and how many once more."""
    got = blocks.groupBy("skey").agg(F.sum("words").alias("got"))
    due = F.floor(F.col("target") + 0.5)
    missed = F.abs(F.coalesce(F.col("got"), F.lit(0)) - F.col("target")) > F.col("target") * miss
    off = sources.where("s > 0").join(got, "skey", "left").where(missed).select("skey", "s", due.alias("due"))
    return off.select("skey", F.expr("due div s").alias("rounds"), F.expr("due % s").alias("rest"))


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, resolution: int = RESOLUTION) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of ``docs`` (doc_id, text, source)."""
    spark = docs.sparkSession
    sizes = C.stored(sized(docs))
    sources = C.stored(targets(sizes, weights, share, most))
    planned = plan(sources, resolution, share)
    slots = schedule(spark, planned, most)
    # How often each block is taken, and the words taken before it.
    times = C.stored(slots.groupBy("skey", "block").agg(F.count("*").alias("times")))
    blocks = planned.select("skey", "s", "nb", F.explode(F.expr("sequence(0L, nb - 1)")).alias("block"))
    begin = F.expr("(block * s + nb - 1) div nb")
    end = F.expr("((block + 1) * s + nb - 1) div nb")
    blocks = blocks.join(times, ["skey", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0))).withColumn("begin", begin)
    blocks = blocks.select("skey", "block", "begin", "times", (F.col("times") * (end - F.col("begin"))).alias("words"))
    blocks = C.stored(_running(blocks, "block", "words", "before"))
    # What is known of each source: sent to all tasks where its size is small, else joined as a stored table, whose skew is split.
    facts = sources.select("skey", "s", "target").join(planned.select("skey", "nb"), "skey", "left").join(settled(sources, blocks), "skey", "left")
    facts = C.stored(facts.select("skey", "s", "target", "nb", "rounds", "rest"))
    size = facts.agg(F.sum(F.octet_length("skey") + 64)).first()[0] or 0
    facts = F.broadcast(facts) if size <= SENT_BYTES else facts
    # Each document's stretch of its source's line.
    parts = sizes.groupBy("skey", "part").agg(F.sum("size").alias("n"))
    parts = parts.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("skey").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inner = Window.partitionBy("skey", "part").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(parts, ["skey", "part"])
    placed = placed.select("doc_id", "skey", "size", (F.col("base") + F.col("inner")).alias("a")).withColumn("b", F.col("a") + F.col("size"))
    whole = placed.join(facts, "skey")
    # Words taken up to a place p: those before its block and the block's own part, as often as it is taken.
    whole = whole.withColumn("block_a", F.expr("least(a * nb div s, nb - 1)")).withColumn("block_b", F.expr("least(b * nb div s, nb - 1)"))

    def upto(df, end):
        side = blocks.select("skey", F.col("block").alias(f"block_{end}"), F.col("begin").alias("x"), F.col("times").alias("t"), F.col("before").alias("y"))
        return df.join(side, ["skey", f"block_{end}"], "left").withColumn(f"up_{end}", F.col("y") + F.col("t") * (F.col(end) - F.col("x"))).drop("x", "y", "t")

    out = upto(upto(whole, "a"), "b")
    exact = F.col("rounds") * F.col("size") + F.least("b", "rest") - F.least("a", "rest")
    taken = F.when(F.col("rounds").isNotNull(), exact).otherwise(F.coalesce(F.col("up_b") - F.col("up_a"), F.lit(0)))
    return out.select("doc_id", "size", F.col("s").alias("source_size"), "target", taken.cast("long").alias("taken"))


def drawn(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as the mix takes it (to the nearest whole document); columns as in ``docs``."""
    times = mixed(docs.select("doc_id", "text", "source"), **options).where("size > 0")
    times = times.groupBy("doc_id").agg(F.max(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int").alias("_times")).where("_times > 0")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).alias("_id")
    joined = docs.select(key, F.struct(*docs.columns).alias("_row")).join(times.select(key, "_times"), "_id")
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document; odd rows as the module says."""
    return mixed(C.table(spark, sf_dir, "documents", "doc_id", "text", "source"))


#: The same for DuckDB, but for the settling of sources that the schedule misses: equal where it misses none by more than MISS.
SQL = r"""
WITH sizes AS (
  SELECT doc_id, coalesce('s' || source, 't') AS skey, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '-')) AS h FROM documents),
g AS (SELECT skey, CAST(sum(size) AS BIGINT) AS s FROM sizes GROUP BY skey),
w AS (SELECT skey, s, CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY skey) - 1) % 3 + 1 AS INT)] AS BIGINT) AS w FROM g),
r AS (SELECT *, CAST(s AS DOUBLE) * 2 / w AS ratio, CAST(sum(s) OVER () AS BIGINT) AS all_s, CAST(sum(w) OVER () AS BIGINT) AS all_w FROM w),
l AS (SELECT *, CAST(coalesce(sum(s) OVER (ORDER BY ratio, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) * 2 AS held,
         CAST(coalesce(sum(w) OVER (ORDER BY ratio, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS gone FROM r),
c AS (SELECT *, ratio <= (CAST(all_s AS DOUBLE) * CAST(1.5 AS DOUBLE) - held) / CAST(all_w - gone AS DOUBLE) AS capped FROM l),
t AS (SELECT skey, s, all_s, CASE WHEN capped THEN CAST(s * 2 AS DOUBLE) ELSE (CAST(all_s AS DOUBLE) * CAST(1.5 AS DOUBLE) - CAST(sum(CASE WHEN capped THEN s * 2 ELSE 0 END) OVER () AS DOUBLE)) * CAST(w AS DOUBLE)
         / CAST(sum(CASE WHEN capped THEN 0 ELSE w END) OVER () AS DOUBLE) END AS target FROM c),
p0 AS (SELECT *, greatest(1, CAST(floor(CAST(s AS DOUBLE) / greatest(CAST(16.0 AS DOUBLE), CAST(all_s AS DOUBLE) * CAST(1.5 AS DOUBLE) / CAST(65536.0 AS DOUBLE)) + CAST(0.5 AS DOUBLE)) AS BIGINT)) AS nb FROM t WHERE s > 0),
p1 AS (SELECT *, CAST(floor(target * CAST(nb AS DOUBLE) / CAST(s AS DOUBLE) * CAST(1000000 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS e FROM p0),
p2 AS (SELECT *, CAST(sum(e) OVER (ORDER BY skey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS top, CAST(sum(e) OVER () AS BIGINT) AS all_e FROM p1 WHERE e > 0),
p AS (SELECT *, CAST(top - e AS DOUBLE) / CAST(all_e AS DOUBLE) AS lo, CAST(top AS DOUBLE) / CAST(all_e AS DOUBLE) AS hi FROM p2),
i AS (SELECT i AS slot, CAST(i AS DOUBLE) * CAST(0.6180339887498949 AS DOUBLE) AS y FROM range((SELECT CAST(floor(CAST(max(all_e) AS DOUBLE) / CAST(1000000.0 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) FROM p)) t(i)),
got AS (SELECT skey, nb, row_number() OVER (PARTITION BY skey ORDER BY slot) - 1 AS r FROM i JOIN p ON y - floor(y) >= lo AND y - floor(y) < hi),
times AS (SELECT skey, r % nb AS block, count(*) AS times FROM got WHERE r < nb * 2 GROUP BY 1, 2),
blocks AS (SELECT p.skey, block, s, nb, (block * s + nb - 1) // nb AS a, ((block + 1) * s + nb - 1) // nb AS b FROM (SELECT skey, s, nb, unnest(range(nb)) AS block FROM p) p),
used AS (SELECT b.skey, b.a, b.b, coalesce(t.times, 0) AS times FROM blocks b LEFT JOIN times t USING (skey, block)),
placed AS (SELECT doc_id, skey, size, CAST(coalesce(sum(size) OVER (PARTITION BY skey ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a FROM sizes),
cut AS (SELECT x.doc_id, x.skey, x.a, x.size, CAST(sum(greatest(0, least(u.b, x.a + x.size) - greatest(u.a, x.a)) * u.times) AS BIGINT) AS taken
         FROM placed x JOIN used u ON u.skey = x.skey AND u.a < x.a + x.size AND u.b > x.a WHERE x.size > 0 GROUP BY ALL)
SELECT x.doc_id, x.size, t.s AS source_size, t.target, coalesce(c.taken, 0) AS taken
FROM placed x JOIN t USING (skey) LEFT JOIN cut c ON c.doc_id IS NOT DISTINCT FROM x.doc_id AND c.skey = x.skey AND c.a = x.a AND c.size = x.size
"""
