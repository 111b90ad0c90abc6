"""Queries through stores and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from celerix.plans import sql
from celerix.plans.registry import query
from celerix.session import fresh
from celerix.sources import store, tables
from celerix.streaming import incremental


@query(f"WITH {sql.BASKETS} SELECT obs_id, var_id, value FROM x")
def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "store")
    store.write_store(tables.baskets(spark, sf_dir), path, block_rows=50)
    return store.open_store(spark, path).x.select("obs_id", "var_id", "value")


@query(f"WITH {sql.BASKETS} SELECT CAST(obs_id // 16 AS BIGINT) AS block, count(DISTINCT obs_id) AS n_rows, count(*) AS entries, sum(value) AS total FROM x GROUP BY 1")
def row_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = store.iter_row_blocks(tables.baskets(spark, sf_dir).x, 16)
    return blocks.select("block", F.size("ids").cast("long").alias("n_rows"), F.size("values").cast("long").alias("entries"), F.aggregate("values", F.lit(0.0), lambda s, v: s + v).alias("total"))


@query("SELECT user_id AS obs_id, sum(n) AS total_counts, count(*) AS n_genes_by_counts FROM (SELECT user_id, event_type, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def streaming_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.qc_of_stream(spark, f"{sf_dir}/events.parquet")
