"""Documents to training tokens: each stage takes what its predecessor kept; the stages go through Parquet."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from celerix.llm import decontaminate, jaccard_join, language_ppm, mixing, tokens_repair
from celerix.llm.common import scratch, stored, table, text_id


# Every stage takes null texts, repeated rows, null and repeated doc_ids, extra columns of any name, texts of any length
# and empty tables: rows are judged by their text, so equal texts share one fate, and all columns are returned as they are.


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in none of the learned languages go: those without a letter, and those that the best language's model cannot compress."""
    return language_ppm.keep_identified(docs, language_ppm.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of like ones stays: that with the least doc_id. Wordless ones are like nothing and stay."""
    return jaccard_join.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold a full window of a benchmark item, or of which hits are a twentieth or more."""
    # judged by the text alone, so named by it: a doc_id may be missing or that of other texts too
    named = docs.select(text_id(docs["text"]).alias("doc_id"), docs["text"])
    found = decontaminate.contamination(named, table(spark, sf_dir, "benchmark"))
    leaks = stored(found.filter("full_window or contaminated").select(F.col("doc_id").alias("leaked")).distinct(), "leaks")
    return docs.join(leaks, text_id(docs["text"]) == leaks["leaked"], "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in compressed shards; returned is what the shards hold of each document."""
    return tokens_repair.read_shards(tokens_repair.write_shards(docs, public_tokenizers.path("word_bpe_49k.json")))


def _alone(stage):
    """The stage, after the files that earlier stages stored on their way were deleted."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with scratch(spark, docs):
            return stage(spark, docs, sf_dir)

    return run


STAGES = [(f.__name__, _alone(f)) for f in (language, near_duplicates, benchmark_leaks, mix, tokens)]

#: The tokenizer and the classifier are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
