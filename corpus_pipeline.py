"""A corpus pipeline of five stages over ``documents``; each stage is written as a table and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jointedge.llm import decontam, jaccard, mixing, queries, substring, toxicity
from jointedge.llm.common import drop_saved, saved_apart, small_batches, table, temporary

ORACLE_SQL = None  # a trained classifier is no SQL; tests/llm holds the stages against brute force


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier calls toxic go. Rows are judged one by one, repeats alike; null and empty texts stay."""
    small_batches(spark)
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, that of the smallest doc_id (null ids last); texts without words are one group."""
    small_batches(spark)
    return jaccard.keep_first(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that start in an earlier document leave the texts; no row goes, and a text without repeats stays as it was."""
    small_batches(spark)
    return substring.without_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold enough of a benchmark item go. Rows are judged one by one; null and empty texts stay."""
    small_batches(spark)
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the mixture with their texts and the times each is taken; texts without words are never taken, and repeats are rows of their own."""
    return mixing.mixture(docs, queries.domain_of(F.col("source")), queries.WEIGHTS, queries.MIX_PERCENT, queries.MIX_EPOCHS, queries.MIX_SEED, carry=("text",))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", drop_contaminated),
    ("mixture", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Tables of a stage go when its result is written, and each stage's result when the next has read it."""
    docs = source = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with temporary(spark):
            kept = stage(spark, docs, sf_dir)
            out = saved_apart(kept, name)
        if docs is not source:
            drop_saved(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
