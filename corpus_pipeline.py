"""A corpus pipeline: quality rules, near duplicates, repeated passages, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns what goes on; between stages
the rows are written to the shared folder and read again, so a lost executor
never repeats an earlier stage, and what the stage stored on its way is deleted.

All stages take tables as they come: nulls in any column, empty and very long
texts, repeated rows, further columns with any names (which they pass on), and
empty tables, of which every stage makes an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomalign.llm import common, mixing, ngram_join, packing, quality_rules, substring_dedup


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines are content for the most part, and that plain rules don't reject.

    Null and empty texts, having fewer than ten words, go.  Rows without doc_id
    and repeated rows are judged like others; a share equal to the limit stays.
    """
    common.bounded_batches(spark)
    return quality_rules.kept(docs, quality_rules.fit(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least id.

    Null and empty texts, and rows without doc_id, are in no group and stay.
    Rows that repeat the row that stays, id and all, stay with it.
    """
    common.bounded_batches(spark)
    return ngram_join.kept(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 400-byte strings that occur more than once.

    No row goes: a null text stays null, and one that repeats as a whole becomes
    what is below 400 bytes of it, or empty.  Ids play no part.
    """
    common.bounded_batches(spark)
    out = substring_dedup.cleaned(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Texts that are null, empty or without words go.  A null source is a source of its
    own; documents of one id are taken as often as the one taken most.
    """
    return mixing.drawn(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most 2048 tokens.

    A null or empty text is one piece, the closing id; a row that is there twice
    is packed twice.
    """
    common.bounded_batches(spark)
    return packing.packed_documents(docs)


STAGES = [
    ("quality_rules", keep_quality),
    ("ngram_join", drop_near_duplicates),
    ("substring_dedup", remove_repeats),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL can't express the field's decoding, nor suffix arrays, tokenizers and best-fit; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from the table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = common.stored_paths()
    for _, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir))
        common.release(spark, [p for p in common.stored_paths()[:-1] if p not in kept])
    return STAGES[-1][1](spark, docs, sf_dir)
