"""Files read once, records by number."""

import random

import pytest

from loomalign.sources import fasta, fasta_index


def _file(r, n, width=7):
    """(text, [(header, seq)]) with blank lines, carriage returns and '>' inside lines."""
    text, rows = "", []
    for i in range(n):
        seq = "".join(r.choice("ARNDC>") for _ in range(r.randint(1, 60)))
        seq = seq.replace(">", "A", 1) if seq[0] == ">" else seq
        lines = [seq[k : k + width] for k in range(0, len(seq), width)]
        lines = [x if not x.startswith(">") else "A" + x[1:] for x in lines]
        rows.append((f"h{i} é > x", "".join(lines)))
        text += f">h{i} é > x" + r.choice(["\n", "\r\n"]) + "".join(x + r.choice(["\n", "\r\n", "\n\n"]) for x in lines)
    return text, rows


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_ranges(spark, tmp_path, small_splits):
    """Many files of many splits: records by number, in order of file names and places."""
    r, want = random.Random(3), []
    (tmp_path / "db").mkdir()
    for name, n in (("b.fa", 200), ("a.fa", 3), ("c.fa", 1), ("d.fa", 90)):
        text, rows = _file(r, n)
        (tmp_path / "db" / name).write_bytes(text.encode())
        want.append((name, rows))
    want = [row for _, rows in sorted(want) for row in rows]
    store = str(tmp_path / "store")
    fasta_index.build(spark, str(tmp_path / "db"), store)
    index = fasta_index.index_of(spark, store).collect()
    assert len(index) > 8 and sum(x.n for x in index) == len(want) and sum(x.residues for x in index) == sum(len(s) for _, s in want)
    for start, stop in ((0, None), (0, 25), (3, 4), (0, 0), (150, 230), (293, 999), (5000, None)):
        got = sorted(fasta_index.read_range(spark, store, start, stop).collect())
        assert [(x.target_id, x.header, x.seq, x.len) for x in got] == [(i, h, s, len(s)) for i, (h, s) in enumerate(want)][start:stop]
    plain = {(x.header, x.seq) for x in fasta.read_fasta(spark, str(tmp_path / "db")).collect()}
    assert plain == set(want)
    with pytest.raises(ValueError):
        fasta_index.read_range(spark, store, 5, 4)


def _scanned(plan):
    """Rows that left the Parquet scans of records in a plan that has run."""
    if plan.nodeName().startswith("AdaptiveSparkPlan"):
        return _scanned(plan.executedPlan())
    total, leaves = 0, plan.collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.nodeName().endswith("QueryStage"):
            total += _scanned(leaf.plan())
        elif leaf.nodeName().startswith("Scan parquet") and "header" in leaf.toString():
            total += leaf.metrics().apply("numOutputRows").value()
    return total


def test_early_stop_reads_one_split_of_many(spark, tmp_path, small_splits):
    text, rows = _file(random.Random(4), 1000)
    (tmp_path / "one.fa").write_bytes(text.encode())
    store = str(tmp_path / "store")
    fasta_index.build(spark, str(tmp_path / "one.fa"), store)
    splits = sorted(fasta_index.index_of(spark, store).collect(), key=lambda x: x.first)
    assert len(splits) > 10
    first = fasta_index.read_range(spark, store, 0, 25)
    assert len(first.collect()) == 25
    needed = sum(x.n for x in splits if x.first < 25)
    assert _scanned(first._jdf.queryExecution().executedPlan()) == needed < 100
    pushed = first._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in pushed and "Scan text" not in pushed
    whole = fasta_index.read_range(spark, store)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in whole and "Scan text" not in whole


@pytest.mark.parametrize(("text", "problem"), [("ARN\n>a\nA\n", "begins with"), (">a\n>b\nARN\n", "followed by"), (">a\nA\n>b\n>c\nA\n", "followed by"), (">a\nA\n>b\n\n", None), (">a\nA\n>b\n>c\n", "followed by"), ("", None), (">a\n", None)])
def test_validation(spark, tmp_path, text, problem):
    (tmp_path / "db").mkdir()
    (tmp_path / "db" / "x.fa").write_text(text)
    (tmp_path / "db" / "y.fa").write_text(">y\nAR\n")
    store = str(tmp_path / "store")
    if problem:
        with pytest.raises(Exception, match=problem):
            fasta_index.build(spark, str(tmp_path / "db"), store)
    else:
        fasta_index.build(spark, str(tmp_path / "db"), store)
        got = [(x.target_id, x.header) for x in sorted(fasta_index.read_range(spark, store).collect())]
        assert got == [(i, h) for i, h in enumerate((["a"] if "A" in text else []) + ["y"])]
    if problem == "followed by":
        fasta_index.build(spark, str(tmp_path / "db"), store, strict=False)
        assert fasta_index.read_range(spark, store).count() == text.count("\nA") + 1


def test_bare_header_at_the_end_of_a_split(spark, tmp_path):
    """Whether a bare header is a file's last record does not depend on where splits end."""
    head = ">a\n" + "A" * 50 + "\n"
    for tail, good in ((">bare header\n", True), (">bare header\n" + "\n" * 40, True), (">bare header\n>c\nARN\n", False)):
        (tmp_path / "x.fa").write_text(head + tail)
        old = spark.conf.get("spark.sql.files.maxPartitionBytes")
        try:
            for size in range(48, 76, 3):
                spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
                if good:
                    fasta_index.build(spark, str(tmp_path / "x.fa"), str(tmp_path / "s"))
                else:
                    with pytest.raises(ValueError, match="followed by"):
                        fasta_index.build(spark, str(tmp_path / "x.fa"), str(tmp_path / "s"))
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
