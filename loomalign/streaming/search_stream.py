"""Extension: search of a stream of sequences, of a folder that FASTA files arrive in, and the best hits of event-time windows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from loomalign.operators.search import search
from loomalign.sources.fasta_index import RECORDS, parsed


def stream_fasta(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """(file, block, at, header, seq, len) of records in files that arrive in a folder; records without sequence are left out.

    ``block`` is where the split that a record was read in begins, ``at`` its
    number in it: with the file they name a record, also where headers repeat.
    """
    raw = spark.readStream.option("lineSep", "\n>").option("maxFilesPerTrigger", files_per_trigger).text(folder)
    rows = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).mapInArrow(parsed, RECORDS)
    return rows.where("not bare").select("file", "block", "at", "header", "seq", "len")


def search_stream(targets: DataFrame, query: str, algorithm: str = "sw", **options) -> DataFrame:
    """Scores of a stream: no state, each row by itself.  target_id is a hash of what names the record."""
    keyed = targets.withColumn("target_id", F.xxhash64("file", "block", "at"))
    return search(keyed, query, algorithm, **options)


def best_hits(scores: DataFrame, k: int, window: str) -> DataFrame:
    """(query_id, start, rank, target_id, score): the k best targets of each query in each window of ``ts``; equal scores by id."""
    of = Window.partitionBy("query_id", "start").orderBy(F.desc("score"), "target_id")
    rows = scores.where("score is not null and ts is not null").withColumn("start", F.window("ts", window).start)
    return rows.withColumn("rank", F.row_number().over(of)).where(F.col("rank") <= k).select("query_id", "start", "rank", "target_id", "score")


def best_hits_stream(scores: DataFrame, k: int, window: str, delay: str) -> DataFrame:
    """The same for a stream of scores (query_id, target_id, score, ts), each window once, when the watermark has passed its end.

    State is the k best of each query and open window, whatever arrives.  Rows
    more than ``delay`` behind the latest one are late and dropped.
    """
    rows = scores.where("score is not null and ts is not null").withWatermark("ts", delay)
    spans = F.window("ts", window)
    rows = rows.select("query_id", spans.start.alias("start"), F.unix_millis(spans.end).alias("end_ms"), "target_id", "score", "ts")

    def keep(key, batches, state):
        query_id, start = key
        if state.hasTimedOut:
            ids, values, _ = state.get
            state.remove()
            yield pd.DataFrame({"query_id": query_id, "start": start, "rank": range(1, len(ids) + 1), "target_id": ids, "score": values})
            return
        ids, values, end = state.get if state.exists else ([], [], 0)
        best = list(zip(values, ids, strict=True))
        for batch in batches:
            best += zip(batch["score"].tolist(), batch["target_id"].tolist(), strict=True)
            best = sorted(best, key=lambda x: (-x[0], x[1]))[:k]
            end = int(batch["end_ms"].iloc[0])
        state.update(([i for _, i in best], [v for v, _ in best], end))
        state.setTimeoutTimestamp(end)

    out = "query_id string, start timestamp, rank int, target_id long, score int"
    return rows.groupBy("query_id", "start").applyInPandasWithState(keep, out, "ids array<long>, scores array<int>, end long", "append", GroupStateTimeout.EventTimeTimeout)
