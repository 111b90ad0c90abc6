"""Quality control and filters. Implicit zeros count: every figure is per row of obs or var, stored entries or not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from celerix.frame import AnnFrame


def per_obs(frame: AnnFrame, layer: str | None = None) -> DataFrame:
    """obs_id, total_counts, n_genes_by_counts (entries other than 0)."""
    got = frame.matrix(layer).groupBy("obs_id").agg(F.sum("value").alias("t"), F.count_if(F.col("value") != 0).alias("n"))
    return frame.obs.select("obs_id").join(got, "obs_id", "left").select("obs_id", F.coalesce("t", F.lit(0.0)).alias("total_counts"), F.coalesce("n", F.lit(0)).alias("n_genes_by_counts"))


def per_var(frame: AnnFrame, layer: str | None = None) -> DataFrame:
    """var_id, total_counts, n_cells_by_counts, mean_counts, pct_dropout_by_counts."""
    n = frame.n_obs
    got = frame.matrix(layer).groupBy("var_id").agg(F.sum("value").alias("t"), F.count_if(F.col("value") != 0).alias("k"))
    out = frame.var.select("var_id").join(got, "var_id", "left").select("var_id", F.coalesce("t", F.lit(0.0)).alias("total_counts"), F.coalesce("k", F.lit(0)).alias("n_cells_by_counts"))
    return out.withColumn("mean_counts", F.col("total_counts") / n).withColumn("pct_dropout_by_counts", 100 * (1 - F.col("n_cells_by_counts") / n))


def _bounds(values: DataFrame, limits: list[tuple[str, float | None, float | None]]) -> Column:
    if all(lo is None and hi is None for _, lo, hi in limits):
        raise ValueError("give a bound")
    ok = F.lit(True)
    for name, lo, hi in limits:
        ok = ok & (F.col(name) >= lo if lo is not None else F.lit(True)) & (F.col(name) <= hi if hi is not None else F.lit(True))
    return ok


def filter_cells(frame: AnnFrame, min_counts: float | None = None, max_counts: float | None = None, min_genes: int | None = None, max_genes: int | None = None, inplace: bool = True) -> AnnFrame | DataFrame:
    """Rows within all bounds given (inclusive), with the columns that they used; inplace=False: obs_id, keep and the columns."""
    rows = per_obs(frame).toDF("obs_id", "n_counts", "n_genes")
    return _filter(frame, rows, [("n_counts", min_counts, max_counts), ("n_genes", min_genes, max_genes)], "obs_id", inplace)


def filter_genes(frame: AnnFrame, min_counts: float | None = None, max_counts: float | None = None, min_cells: int | None = None, max_cells: int | None = None, inplace: bool = True) -> AnnFrame | DataFrame:
    rows = per_var(frame).select("var_id", F.col("total_counts").alias("n_counts"), F.col("n_cells_by_counts").alias("n_cells"))
    return _filter(frame, rows, [("n_counts", min_counts, max_counts), ("n_cells", min_cells, max_cells)], "var_id", inplace)


def _filter(frame, rows, limits, key, inplace):
    used = [name for name, lo, hi in limits if lo is not None or hi is not None]
    told = rows.select(key, *used, _bounds(rows, limits).alias("keep"))
    if not inplace:
        return told
    if key == "obs_id":
        return frame.with_obs_cols(told).where_obs("keep")._without("obs", "keep")
    return frame.with_var_cols(told).where_var("keep")._without("var", "keep")


def flag_gene_family(frame: AnnFrame, name: str, column: str = "var_id", startswith: str | None = None, endswith: str | None = None, contains: str | None = None) -> AnnFrame:
    """A boolean column of var: the first given of startswith, endswith, contains; none raises."""
    text = F.col(column).cast("string")
    tests = [(startswith, text.startswith), (endswith, text.endswith), (contains, text.contains)]
    for value, test in tests:
        if value is not None:
            return frame.with_var_cols(frame.var.select("var_id", F.coalesce(test(value), F.lit(False)).alias(name)))
    raise ValueError("give startswith, endswith or contains")


def top_share(frame: AnnFrame, tops: tuple[int, ...] = (50, 100, 200, 500), layer: str | None = None) -> DataFrame:
    """obs_id, pct_counts_in_top_<N>_genes: the share of each row's largest N values; NaN on an empty row."""
    if max(tops) > frame.n_vars:
        raise IndexError(f"there are fewer than {max(tops)} variables")
    ranked = frame.matrix(layer).withColumn("r", F.row_number().over(W.partitionBy("obs_id").orderBy(F.desc("value"), "var_id")))
    got = ranked.groupBy("obs_id").agg(F.sum("value").alias("t"), *[F.sum(F.when(F.col("r") <= n, F.col("value")).otherwise(0.0)).alias(f"s{n}") for n in tops])
    share = [F.when(F.col("t") != 0, F.col(f"s{n}") / F.col("t") * 100).otherwise(F.lit(float("nan"))).alias(f"pct_counts_in_top_{n}_genes") for n in tops]
    return frame.obs.select("obs_id").join(got, "obs_id", "left").select("obs_id", *share)


def calculate_qc_metrics(frame: AnnFrame, qc_vars: tuple[str, ...] = (), percent_top: tuple[int, ...] | None = (50, 100, 200, 500), log1p: bool = True, layer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(per row, per column) figures; qc_vars name boolean columns of var, summed in one pass."""
    obs = per_obs(frame, layer)
    if qc_vars:
        flags = frame.var.select("var_id", *[F.coalesce(F.col(v).cast("boolean"), F.lit(False)).alias(v) for v in qc_vars]).filter(" or ".join(f"`{v}`" for v in qc_vars))
        part = frame.matrix(layer).join(flags, "var_id").groupBy("obs_id").agg(*[F.sum(F.when(F.col(v), F.col("value")).otherwise(0.0)).alias(f"total_counts_{v}") for v in qc_vars])
        obs = obs.join(part, "obs_id", "left").fillna(0.0, [f"total_counts_{v}" for v in qc_vars])
        for v in qc_vars:
            obs = obs.withColumn(f"pct_counts_{v}", F.when(F.col("total_counts") != 0, F.col(f"total_counts_{v}") / F.col("total_counts") * 100).otherwise(F.lit(float("nan"))))
    if percent_top:
        obs = obs.join(top_share(frame, percent_top, layer), "obs_id")
    var = per_var(frame, layer)
    if log1p:
        for c in ("total_counts", "n_genes_by_counts", *(f"total_counts_{v}" for v in qc_vars)):
            obs = obs.withColumn(f"log1p_{c}", F.log1p(F.col(c).cast("double")))
        for c in ("total_counts", "mean_counts"):
            var = var.withColumn(f"log1p_{c}", F.log1p(c))
    return obs, var


def label_sizes(frame: AnnFrame, key: str) -> DataFrame:
    return frame.obs.groupBy(F.col(key).alias("label")).agg(F.count("*").alias("n"))


def require_categorical(frame: AnnFrame, key: str) -> None:
    """Labels are string columns; others raise."""
    if key not in frame.obs.columns:
        raise KeyError(key)
    if dict(frame.obs.dtypes)[key] != "string":
        raise ValueError(f"obs column {key} is not categorical: cast it to string")


def natural_order(labels: DataFrame, column: str) -> DataFrame:
    """label, code: integer-like labels by number, then the others by text."""
    number = F.when(F.col("label").rlike("^[0-9]+$"), F.col("label").cast("decimal(38,0)"))
    distinct = labels.select(F.col(column).alias("label")).distinct()
    return distinct.withColumn("code", F.row_number().over(W.orderBy(number.asc_nulls_last(), "label")) - 1)
