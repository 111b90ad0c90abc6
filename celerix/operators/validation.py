"""Comparing results: values, signed columns, subspaces, fingerprints."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare(a: DataFrame, b: DataFrame, keys: list[str], value: str = "value", rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """One row: n, max_abs, max_rel, rmse, pearson, close (absent keys are 0; NaN equals NaN)."""
    both = a.select(*keys, F.col(value).cast("double").alias("x")).join(b.select(*keys, F.col(value).cast("double").alias("y")), keys, "full").fillna(0.0, ["x", "y"])
    same_nan = F.isnan("x") & F.isnan("y")
    off = F.when(same_nan, 0.0).otherwise(F.abs(F.col("x") - F.col("y")))
    rows = both.withColumn("off", off)
    ok = F.col("off") <= atol + rtol * F.abs("y")
    return rows.agg(
        F.count("*").alias("n"), F.max("off").alias("max_abs"), F.max(F.col("off") / F.greatest(F.abs("y"), F.lit(1e-12))).alias("max_rel"),
        F.sqrt(F.avg(F.col("off") * F.col("off"))).alias("rmse"), F.corr("x", "y").alias("pearson"), F.coalesce(F.bool_and(F.coalesce(ok, F.lit(False)) | same_nan), F.lit(True)).alias("close"),
    )


def compare_masks(a: DataFrame, b: DataFrame, key: str, flag: str) -> DataFrame:
    """One row: n, equal, both, overlap (shared over the smaller set)."""
    rows = a.select(key, F.coalesce(F.col(flag), F.lit(False)).alias("x")).join(b.select(key, F.coalesce(F.col(flag), F.lit(False)).alias("y")), key, "full").fillna(False, ["x", "y"])
    got = rows.agg(F.count("*").alias("n"), F.count_if(F.col("x") == F.col("y")).alias("equal"), F.count_if(F.col("x") & F.col("y")).alias("both"), F.least(F.count_if("x"), F.count_if("y")).alias("least"))
    return got.select("n", "equal", "both", F.when(F.col("least") > 0, F.col("both") / F.col("least")).otherwise(1.0).alias("overlap"))


def compare_signed_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: worst, the least absolute correlation of like components of two vector frames (obs_id, vec)."""
    x = a.select("obs_id", F.posexplode("vec").alias("j", "x"))
    y = b.select("obs_id", F.posexplode("vec").alias("j", "y"))
    return x.join(y, ["obs_id", "j"]).groupBy("j").agg(F.abs(F.corr("x", "y")).alias("r")).agg(F.min("r").alias("worst"))


def subspace_overlap(qa: np.ndarray, qb: np.ndarray) -> float:
    """Squared Frobenius norm of Qa' Qb over the number of columns, for orthonormal bases of both spaces."""
    qa, qb = np.linalg.qr(qa)[0], np.linalg.qr(qb)[0]
    return float(((qa.T @ qb) ** 2).sum() / qa.shape[1])


def fingerprint(x: DataFrame, value: str = "value") -> DataFrame:
    """One row: n, least, greatest, mean, l2, n_odd (values that are not finite)."""
    v = F.col(value).cast("double")
    odd = F.isnan(v) | v.isNull() | (F.abs(v) == float("inf"))
    ok = F.when(~odd, v)
    return x.agg(F.count("*").alias("n"), F.min(ok).alias("least"), F.max(ok).alias("greatest"), F.avg(ok).alias("mean"), F.sqrt(F.sum(ok * ok)).alias("l2"), F.count_if(odd).alias("n_odd"))
