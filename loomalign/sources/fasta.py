"""FASTA in and out of DataFrames, a Parquet cache of databases, and seeded synthetic sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomalign.operators.layout import n_shortest
from loomalign.sources import fasta_index

TARGETS = "target_id long, header string, seq string, len int"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on one machine without a setting, a folder of the warehouse."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    path = f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
    if not spark.sparkContext.master.startswith("local") and path.startswith(("file:", "/")):
        raise RuntimeError("spark.checkpoint.dir is not set, and the warehouse is a folder of one machine")
    return path


def parse_record(value: Column) -> dict[str, Column]:
    """header and seq of one record without its '>' (lines joined, one carriage return of each dropped), and whether it has any line of sequence."""
    lines = F.split(value, "\n")
    body = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    strip = lambda x: F.regexp_replace(x, "\r$", "")
    return {"header": strip(lines[0]), "seq": F.array_join(F.transform(body, strip), ""), "any": F.exists(body, lambda x: x != "")}


#: Files up to which what is known of each is sent to all tasks (some 2 MB).
FEW_FILES = 10_000
_SEPARATOR = "\n>"


def _records(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, target_id): records as the text reader splits them, at a line break and '>'; ids rise in the order of reading."""
    raw = spark.read.option("lineSep", _SEPARATOR).text(path)
    return raw.select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("target_id"))


def _first_ids(raw: DataFrame, n: int) -> int:
    """The id after the first n records with a sequence: partitions are read one after another only until they have n."""
    ids = raw.where(parse_record(F.regexp_replace("value", "^>", ""))["any"]).select("target_id").offset(n - 1).limit(1).collect()
    return ids[0].target_id + 1 if ids else 1 << 62


def read_fasta(spark: SparkSession, path: str, max_seqs: int | None = None, strict: bool = True) -> DataFrame:
    """(target_id, header, seq, len) of a FASTA file or folder.

    Records are split by the reader itself (a line break and '>'), so files of
    any size are read in parallel.  Blank lines are ignored; a line with only a
    carriage return counts as an (empty) sequence line; '>' inside a line is
    data.  A header without sequence lines at the very end is dropped.  With
    ``strict``, a file that does not begin with '>' and a header directly
    followed by another fail when the rows are read; otherwise such records are
    left out.

    max_seqs keeps the first records by id.  Where they end is found by reading
    partition after partition until there are enough; nothing is sorted, and
    what comes after them is not checked.
    """
    raw = _records(spark, path)
    if max_seqs:
        raw = raw.where(F.col("target_id") < _first_ids(raw, max_seqs))
    # The separator is taken off all records but each file's first, which keeps its own '>'.
    rows = raw.select("target_id", "file", "value", *(c.alias(n) for n, c in parse_record(F.regexp_replace("value", "^>", "")).items()))
    # What stands before the first '>' and after the last record: one row for each file.
    ends = raw.groupBy("file").agg(F.min("target_id").alias("first"), F.max("target_id").alias("last"))
    rows = rows.join(F.broadcast(ends) if len(raw.inputFiles()) <= FEW_FILES else ends, "file")
    no_start = (F.col("target_id") == F.col("first")) & ~F.col("value").startswith(">")
    bare = ~F.col("any") & (F.col("target_id") < F.col("last"))
    if strict:
        message = F.when(no_start, "a FASTA file begins with '>'").when(bare, "a header is followed by another header")
        rows = rows.where(F.col("any") | message.isNotNull()).withColumn("seq", F.when(message.isNull(), F.col("seq")).otherwise(F.raise_error(message)))
    else:
        rows = rows.where(F.col("any") & ~no_start)
    return rows.select("target_id", "header", "seq", F.octet_length("seq").alias("len"))


def read_query(spark: SparkSession, path: str, max_len: int | None = 8192) -> str:
    """The first record's sequence, from the beginning of the file alone.  Longer than max_len, or no record: an error."""
    values = [r.value for r in _records(spark, path).limit(2).collect()]
    if not values:
        raise ValueError(f"no sequence in {path}")
    if not values[0].startswith(">"):
        raise ValueError("a FASTA file begins with '>'")
    lines = [x for x in values[0][1:].split("\n")[1:] if x]
    if not lines:
        raise ValueError("a header is followed by another header" if len(values) > 1 else f"no sequence in {path}")
    seq = "".join(x.removesuffix("\r") for x in lines)
    if max_len is not None and len(seq) > max_len:
        raise ValueError(f"the query has {len(seq)} residues; the limit is {max_len}")
    return seq


def _fingerprint(spark: SparkSession, path: str) -> str:
    files = spark.read.format("binaryFile").load(path).select("path", "length", F.col("modificationTime").cast("string").alias("at"))
    parts = F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", "path", "length", "at"))), ";")
    return files.agg(F.md5(parts).alias("key")).first().key


def cached_database(spark: SparkSession, path: str, cache_dir: str, num_seqs: int | None = None) -> DataFrame:
    """The database from a Parquet copy that is made once for each state of the files.

    The files are read once, into records by number (``fasta_index``, which also
    gives ranges of them from the same folder).  The copy that searches read is
    dealt by hash of the number, so that lengths mix and a search scores it
    straight from the scan.  num_seqs takes the *shortest* that many.
    """
    target = f"{cache_dir}/{_fingerprint(spark, path)}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/dealt/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        fasta_index.build(spark, path, target)
        fasta_index.read_range(spark, target).repartition("target_id").write.mode("overwrite").parquet(f"{target}/dealt")
    rows = spark.read.schema(TARGETS).parquet(f"{target}/dealt")
    return n_shortest(rows, num_seqs) if num_seqs else rows


def as_fasta(targets: DataFrame, width: int | None = 80, header: str = "header") -> DataFrame:
    """One text value for each record: '>' and the header, then the sequence in lines of ``width``; a null sequence, which no record can hold, has none."""
    targets, seq = targets.where("seq is not null"), F.col("seq")
    if width:
        seq = F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", "")
    return targets.select(F.concat(F.lit(">"), F.coalesce(F.col(header), F.lit("")), F.lit("\n"), seq).alias("value"))


def write_fasta(targets: DataFrame, path: str, width: int | None = 80, mode: str = "error") -> None:
    as_fasta(targets, width).write.mode(mode).text(path)


def write_sorted_fasta(targets: DataFrame, path: str) -> None:
    """Shortest first, a sequence on one line, without headers' text; an existing path is an error."""
    ordered = targets.withColumn("header", F.lit("")).sort("len", "target_id")
    as_fasta(ordered, None).write.mode("error").text(path)


def write_csv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).option("header", True).csv(path)


def synthetic(spark: SparkSession, n: int, length: Column | int, seed: int = 0, letters: str = "ARNDCQEGHILKMFPSTWYV") -> DataFrame:
    """n seeded random sequences of the given length (a number or an expression of target_id).

    Residue i is the i-th group of four hexadecimal digits, modulo the number of
    letters, of the MD5 sums of seed, id and block number, eight groups a block.
    """
    size = F.lit(length) if isinstance(length, int) else length
    return synthetic_like(spark.range(n).select(F.col("id").alias("target_id"), size.cast("int").alias("len")), seed, letters)


def synthetic_like(rows: DataFrame, seed: int = 0, letters: str = "ARNDCQEGHILKMFPSTWYV") -> DataFrame:
    """A seeded random sequence for each row of (target_id, len): a database of the same shape as another."""
    blocks = F.sequence(F.lit(0), F.floor(F.col("len") / 8).cast("int"))
    digest = F.transform(blocks, lambda k: F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("target_id").cast("string"), k.cast("string"))))
    four = lambda d, i: F.conv(F.substring(d, F.lit(i * 4 + 1), F.lit(4)), 16, 10).cast("int")
    letter = lambda d, i: F.substring(F.lit(letters), four(d, i) % len(letters) + 1, F.lit(1))
    # Eight residues a digest inside one lambda: a digest read by residue would be computed again for each.
    eights = F.transform(digest, lambda d: F.concat(*[letter(d, i) for i in range(8)]))
    seq = F.when(F.col("len") > 0, F.substring(F.array_join(eights, ""), F.lit(1), F.col("len"))).otherwise("")
    return rows.select("target_id", F.concat(F.lit("seq_"), "target_id").alias("header"), seq.alias("seq"), "len")


def uniform(spark: SparkSession, sizes: list[int], each: int, seed: int = 0) -> dict[int, DataFrame]:
    """A synthetic database for each length."""
    return {n: synthetic(spark, each, n, seed + n) for n in sizes}
