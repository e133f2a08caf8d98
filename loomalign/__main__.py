"""python -m loomalign nw|sw NUM_SEQS THRESHOLD QUERY_FASTA DATABASE_FASTA: score, check against the plain engine, report."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> int:
    from loomalign.operators.search import search
    from loomalign.operators.verify import check, measured
    from loomalign.sources.fasta import cached_database, read_query, shared_dir

    def positive(text):
        value = int(text)
        if not 0 < value < 1 << 31:
            raise argparse.ArgumentTypeError("a positive number is wanted")
        return value

    p = argparse.ArgumentParser(prog="loomalign", description=__doc__)
    p.add_argument("algorithm", choices=["nw", "sw"])
    p.add_argument("num_seqs", type=positive)
    p.add_argument("threshold", type=positive)
    p.add_argument("query")
    p.add_argument("database")
    p.add_argument("--cache", default=None, help="shared folder of Parquet copies; spark.checkpoint.dir or, on one machine, beside the warehouse by default")
    p.add_argument("--check", action="store_true", help="also score with the plain engine and compare")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("loomalign").getOrCreate()
    query = read_query(spark, a.query)
    targets = cached_database(spark, a.database, a.cache or f"{shared_dir(spark)}/_fasta", a.num_seqs).cache()
    run = lambda: search(targets, query, a.algorithm, a.threshold)
    if a.check:
        check(search(targets, query, a.algorithm, engine="scalar"), run(), "vector")
    row = measured(targets, query, a.algorithm, "spark", run)
    print(f"{row[3]:.1f} {row[5]:.2f}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
