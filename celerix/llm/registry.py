"""The ten operators' queries with production parameters, their SQL twins, and the pipeline."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from celerix.llm import decontaminate, edit_embedding, html_blocks, jaccard_join, language_ppm, mixing, oracles, relative_lz, tokens_repair, toxicity_gbt, warc_index
from celerix.llm.common import table

TOKENIZER = "word_bpe_49k.json"


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_index.read_archives(warc_index.archive(spark, table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_token_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_repair.read_shards(tokens_repair.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)))


def op3_toxicity_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity_gbt.toxicity(docs, toxicity_gbt.learn(docs, table(spark, sf_dir, "labels")))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.component_ids(table(spark, sf_dir, "documents"))


def op5_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_embedding.fingerprint_edits(table(spark, sf_dir, "documents"))


def op6_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op7_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relative_lz.removal(table(spark, sf_dir, "documents"))


def op8_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_ppm.identify(docs, language_ppm.learn(docs))


def op9_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("full_window")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_warc_index, op2_token_repair, op3_toxicity_gbt, op4_jaccard_join, op5_edit_embedding, op6_html_blocks, op7_relative_lz, op8_language_ppm, op9_entropy_mix, op10_decontaminate, pipeline)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLES)
