"""Streams of FASTA files and of scores."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomalign.functions.scoring import encode
from loomalign.operators import kernels
from loomalign.streaming.search_stream import best_hits, best_hits_stream, search_stream, stream_fasta


def _run(df, out, checkpoint, mode="append"):
    df.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def test_records_of_one_header_have_ids_of_their_own(spark, tmp_path):
    """Equal and empty headers, equal records: as many ids as records; files that come later are searched after a restart."""
    folder = tmp_path / "in"
    folder.mkdir()
    seqs = ["ARNDC", "ARNDC", "HEAGAWGHEE", "PAWHEAE"]
    (folder / "a.fa").write_text("".join(f">\n{s}\n" for s in seqs))
    (folder / "b.fa").write_text(">x\nARNDC\n>x\nARNDC\n>bare\n")

    def search_all():
        _run(search_stream(stream_fasta(spark, str(folder)), "HEAGAWGHEE"), tmp_path / "out", tmp_path / "checkpoint")
        return spark.read.parquet(str(tmp_path / "out")).collect()

    rows = search_all()
    assert len(rows) == 6 and len({r.target_id for r in rows}) == 6
    want = sorted(int(kernels.scalar("sw", encode("HEAGAWGHEE"), encode(s))) for s in [*seqs, "ARNDC", "ARNDC"])
    assert sorted(r.score for r in rows) == want
    (folder / "c.fa").write_text(">\nAAA\n")
    assert len(search_all()) == 7


@pytest.fixture
def arrivals(spark, tmp_path):
    r = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    rows = [(r.choice("ab"), r.randint(0, 50), r.randint(0, 9), start + dt.timedelta(minutes=i * 3 + r.randint(0, 4))) for i in range(300)]
    rows += [("a", None, None, start), ("a", 1, 5, None)]
    return rows


def _write(folder, rows, name):
    folder.mkdir(exist_ok=True)
    frame = pd.DataFrame(rows, columns=["query_id", "target_id", "score", "ts"])
    frame = frame.astype({"target_id": "Int64", "score": "Int32"})
    frame["ts"] = pd.to_datetime(frame.ts).astype("datetime64[us]")
    frame.to_parquet(folder / name)


SCHEMA = "query_id string, target_id long, score int, ts timestamp"


def test_windows_of_a_stream_equal_a_batch(spark, tmp_path, arrivals):
    """Files in turn, with a stop between: every closed window as a batch has it, once; late rows are left out."""
    folder, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "check"

    def go():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
        _run(best_hits_stream(stream, 3, "1 hour", "30 minutes"), out, checkpoint)
        return [tuple(x) for x in spark.read.parquet(str(out)).collect()]

    _write(folder, arrivals[:100], "0.parquet")
    first = go()
    _write(folder, arrivals[100:200], "1.parquet")
    go()
    # Hours behind all that has been seen: too late for its window.
    _write(folder, [*arrivals[200:], ("a", 77, 99, dt.datetime(2024, 1, 1, 0, 30))], "2.parquet")
    _write(folder, [("z", 0, 0, dt.datetime(2024, 2, 1))], "3.parquet")
    got = go()
    batch = spark.createDataFrame([r for r in arrivals if r[0] != "z"], SCHEMA)
    want = [tuple(x) for x in best_hits(batch, 3, "1 hour").collect()]
    assert sorted(got) == sorted(want) and set(first) < set(got) and len(first) > 5
    assert spark.createDataFrame([], SCHEMA).transform(lambda d: best_hits(d, 3, "1 hour")).collect() == []


def test_state_is_bounded(spark, tmp_path):
    """The state of a window is its k best, however many rows it gets."""
    _write(tmp_path / "in", [("a", i, i % 7, dt.datetime(2024, 1, 1, 0, 1)) for i in range(5000)], "0.parquet")
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    _run(best_hits_stream(stream, 2, "1 hour", "1 minute"), tmp_path / "out", tmp_path / "check")
    state = spark.read.format("statestore").load(str(tmp_path / "check")).select(F.to_json("value").alias("v")).collect()
    assert len(state) == 1 and len(state[0].v) < 400
