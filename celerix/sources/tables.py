"""Annotated matrices from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from celerix.frame import AnnFrame

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> AnnFrame:
    """Documents x terms: counts of `[a-z]+` in texts whose A-Z are lower-cased; obs has lang and source."""
    docs = table(spark, sf_dir, "documents")
    terms = docs.select(F.col("doc_id").alias("obs_id"), F.explode(F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit("[a-z]+"), F.lit(0))).alias("var_id"))
    x = terms.groupBy("obs_id", "var_id").agg(F.count("*").cast("double").alias("value"))
    return AnnFrame(docs.select(F.col("doc_id").alias("obs_id"), "lang", "source"), x.select("var_id").distinct(), x)


def baskets(spark: SparkSession, sf_dir: str) -> AnnFrame:
    """Suppliers x parts: quantities; obs has nation and grp (supplier modulo 3), var has brand, type and flag."""
    x = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("obs_id"), F.col("l_partkey").alias("var_id")).agg(F.sum("l_quantity").alias("value"))
    obs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("obs_id"), F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 3).cast("string").alias("grp"))
    var = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("var_id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_name").alias("name"))
    return AnnFrame(obs, var, x)


def events(spark: SparkSession, sf_dir: str) -> AnnFrame:
    """Users x event types: counts."""
    x = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("obs_id"), F.col("event_type").alias("var_id")).agg(F.count("*").cast("double").alias("value"))
    return AnnFrame(x.select("obs_id").distinct(), x.select("var_id").distinct(), x)


def vectors(spark: SparkSession, sf_dir: str) -> AnnFrame:
    """Embeddings as obsm `X_pca`, their first two components as `spatial`; obs has label, cluster and library; x are the components."""
    table_ = table(spark, sf_dir, "embeddings")
    vec = table_.select(F.col("vec_id").alias("obs_id"), F.transform("embedding", lambda v: v.cast("double")).alias("vec"))
    obs = table_.select(F.col("vec_id").alias("obs_id"), "label", F.concat(F.lit("c"), F.col("label")).alias("cluster"), F.concat(F.lit("lib"), F.col("label") % 3).alias("library"))
    x = vec.select("obs_id", F.posexplode("vec").alias("var_id", "value"))
    return AnnFrame(obs, x.select("var_id").distinct(), x.filter("value <> 0"), obsm={"X_pca": vec, "spatial": vec.select("obs_id", F.slice("vec", 1, 2).alias("vec"))})
