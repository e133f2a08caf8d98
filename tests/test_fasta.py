import pytest
from pyspark.sql import functions as F

from loomalign.sources import datasource, fasta
from loomalign.streaming.search_stream import search_stream, stream_fasta


def _write(tmp_path, text, name="x.fasta"):
    (tmp_path / name).write_bytes(text.encode())
    return str(tmp_path / name)


def _rows(df):
    return [(r.header, r.seq, r.len) for r in df.orderBy("target_id").collect()]


def test_read(spark, tmp_path):
    path = _write(tmp_path, ">s1 first\r\nARND\r\n\r\nCQ\r\n>s2\nAC\n\nDE>F\n>s3\nW")
    want = [("s1 first", "ARNDCQ", 6), ("s2", "ACDE>F", 6), ("s3", "W", 1)]
    assert _rows(fasta.read_fasta(spark, path)) == want
    assert _rows(fasta.read_fasta(spark, path, 2)) == want[:2]
    datasource.register(spark)
    assert _rows(spark.read.format("fasta").load(path)) == want


def test_corner_cases(spark, tmp_path):
    assert _rows(fasta.read_fasta(spark, _write(tmp_path, ">a\nW\n>last"))) == [("a", "W", 1)]
    assert _rows(fasta.read_fasta(spark, _write(tmp_path, ">a\n\r\n>b\nW"))) == [("a", "", 0), ("b", "W", 1)]
    for bad in ("ARND\n>a\nW", ">a\n>b\nW\n"):
        path = _write(tmp_path, bad)
        with pytest.raises(Exception, match="FASTA|header"):
            fasta.read_fasta(spark, path).collect()
    assert len(_rows(fasta.read_fasta(spark, _write(tmp_path, ">a\n>b\nW\n"), strict=False))) == 1


def test_query(spark, tmp_path):
    path = _write(tmp_path, ">header\nARNDCQEGHILKMFPSTWYV\n>other\nW\n")
    assert fasta.read_query(spark, path) == "ARNDCQEGHILKMFPSTWYV"
    with pytest.raises(ValueError, match="limit"):
        fasta.read_query(spark, path, 5)
    for bad in ("", ">a\n>b\nW", "ARND\n>a\nW", ">a", ">a\n\n"):
        with pytest.raises(ValueError):
            fasta.read_query(spark, _write(tmp_path, bad))
    assert fasta.read_query(spark, _write(tmp_path, ">a\r\nAR\r\n\r\nND\r\n>b\nW")) == "ARND"


def test_early_stop(spark, tmp_path):
    """The first records by id, and nothing after them is checked."""
    good = "".join(f">s{i}\nARND\n" for i in range(50))
    path = _write(tmp_path, good + ">bare\n>x\nW\n")
    assert [r[0] for r in _rows(fasta.read_fasta(spark, path, 50))] == [f"s{i}" for i in range(50)]
    with pytest.raises(Exception, match="header"):
        fasta.read_fasta(spark, path).collect()
    plan = fasta.read_fasta(spark, path, 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Sort" not in plan
    assert fasta.read_fasta(spark, _write(tmp_path, good), 500).count() == 50


def test_few_files_are_not_shuffled(spark, tmp_path):
    for k in range(3):
        _write(tmp_path, f">a{k}\nARND\n>b{k}\nW\n", f"{k}.fa")
    rows = fasta.read_fasta(spark, str(tmp_path / "*.fa"))
    assert rows.count() == 6 and "BroadcastHashJoin" in rows._jdf.queryExecution().executedPlan().toString()


def test_shared_dir(spark):
    """Without a shared folder, a cluster whose warehouse is one machine's gets an error and not files that others can't see."""

    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context

        class conf:
            values = {"spark.sql.warehouse.dir": "file:/tmp/x"}

            @classmethod
            def get(cls, key, default=None):
                return cls.values.get(key, default)

    with pytest.raises(RuntimeError):
        fasta.shared_dir(Session)
    Session.conf.values["spark.checkpoint.dir"] = "hdfs:///tmp/x"
    assert fasta.shared_dir(Session) == "hdfs:///tmp/x"


def test_sinks_and_cache(spark, tmp_path):
    db = fasta.synthetic(spark, 30, F.lit(5) + F.col("target_id") % 90, seed=1)
    assert db.collect() == fasta.synthetic(spark, 30, F.lit(5) + F.col("target_id") % 90, seed=1).collect()
    fasta.write_fasta(db, str(tmp_path / "db"))
    assert max(map(len, (x for p in (tmp_path / "db").glob("part*") for x in p.read_text().splitlines()))) == 34
    want = {(r.header, r.seq) for r in db.collect()}
    assert {(r.header, r.seq) for r in fasta.read_fasta(spark, str(tmp_path / "db")).collect()} == want
    got = fasta.cached_database(spark, str(tmp_path / "db"), str(tmp_path / "cache"), 4)
    assert [r.len for r in got.collect()] == [5, 6, 7, 8]
    assert fasta.cached_database(spark, str(tmp_path / "db"), str(tmp_path / "cache")).count() == 30
    assert len(list((tmp_path / "cache").iterdir())) == 1
    fasta.write_sorted_fasta(db, str(tmp_path / "sorted"))
    with pytest.raises(Exception):  # noqa: B017
        fasta.write_sorted_fasta(db, str(tmp_path / "sorted"))
    fasta.write_csv(db, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 30


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    _write(folder, ">a\nARND\n>b\nW\n", "1.fasta")
    _write(folder, ">c\nAR\nND\n", "2.fasta")
    scores = search_stream(stream_fasta(spark, str(folder)), "ARND", "sw")
    q = scores.writeStream.format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.score for r in spark.table("hits").collect()) == [0, 21, 21]


def test_command(spark, tmp_path, capsys):
    from loomalign.__main__ import main

    db = _write(tmp_path, "".join(f">s{i}\n{'ARND' * (i + 1)}\n" for i in range(20)), "db.fasta")
    q = _write(tmp_path, ">q\nARNDCQ\n", "q.fasta")
    assert main(["sw", "10", "8", q, db, "--cache", str(tmp_path / "c"), "--check"]) == 0
    assert len(capsys.readouterr().out.split()) >= 2
    with pytest.raises(SystemExit):
        main(["sw", "0", "8", q, db])


def test_null_sequences_are_not_written(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "ARN"), (2, "b", None), (3, "c", "D")], "target_id long, header string, seq string")
    fasta.write_fasta(rows, str(tmp_path / "out"))
    assert sorted(r.header for r in fasta.read_fasta(spark, str(tmp_path / "out")).collect()) == ["a", "c"]
