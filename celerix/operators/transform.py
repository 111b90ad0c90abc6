"""Elementwise and per-row transforms of the matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from celerix.frame import AnnFrame
from celerix.operators import qc


def normalize_total(frame: AnnFrame, target_sum: float | None = None, layer: str | None = None, key_added: str | None = None, exclude_highly_expressed: bool = False) -> AnnFrame:
    """Rows scaled to target_sum, by default the median of all rows' totals (empty ones too); rows of total 0 or less become 0."""
    if exclude_highly_expressed:
        raise NotImplementedError("exclude_highly_expressed")
    totals = qc.per_obs(frame, layer).select("obs_id", F.col("total_counts").alias("_t"))
    goal = F.lit(float(target_sum)) if target_sum is not None else F.col("_goal")
    if target_sum is None:
        totals = totals.crossJoin(F.broadcast(totals.agg(F.median("_t").alias("_goal"))))  # one row
    x = frame.matrix(layer)
    scaled = x.join(totals, "obs_id").filter("_t > 0").select("obs_id", "var_id", (F.col("value") * (goal / F.col("_t"))).alias("value"))
    out = frame.with_x(scaled, layer)
    return out.with_obs_cols(totals.select("obs_id", (F.col("_t") / goal).alias(key_added))) if key_added else out


def log1p(frame: AnnFrame, layer: str | None = None) -> AnnFrame:
    x = frame.matrix(layer)
    return frame.with_x(x.withColumn("value", F.log1p("value")), layer).with_uns(log1p={"base": None})


def moments(frame: AnnFrame, layer: str | None = None, expm1: bool = False) -> DataFrame:
    """var_id, mean, var (ddof 1) over all rows; expm1: of exp(value) - 1."""
    n = frame.n_obs
    value = F.expm1("value") if expm1 else F.col("value")
    got = frame.matrix(layer).groupBy("var_id").agg(F.sum(value).alias("t"), F.sum(value * value).alias("q"))
    out = frame.var.select("var_id").join(got, "var_id", "left").fillna(0.0, ["t", "q"])
    mean = F.col("t") / n
    return out.select("var_id", mean.alias("mean"), ((F.col("q") - n * mean * mean) / max(n - 1, 1)).alias("var"))


def dense(frame: AnnFrame, layer: str | None = None) -> DataFrame:
    """Every (obs_id, var_id) with its value or 0. For narrow frames: as large as obs x var."""
    grid = frame.obs.select("obs_id").crossJoin(frame.var.select("var_id"))
    return grid.join(frame.matrix(layer), ["obs_id", "var_id"], "left").fillna(0.0, ["value"])


def scale(frame: AnnFrame, max_value: float | None = None, zero_center: bool = True, layer: str | None = None) -> AnnFrame:
    """(x - mean) / std by column, std with ddof 1 and 1 for constant columns; clipped above, and below if centred.

    Without centring zeros stay zeros and nothing is densified.
    """
    stats = moments(frame, layer).select("var_id", "mean", F.when(F.sqrt(F.greatest("var", F.lit(0.0))) == 0, F.lit(1.0)).otherwise(F.sqrt(F.greatest("var", F.lit(0.0)))).alias("std"))
    x = dense(frame, layer) if zero_center else frame.matrix(layer)
    value = (F.col("value") - F.col("mean")) / F.col("std") if zero_center else F.col("value") / F.col("std")
    if max_value is not None:
        value = F.least(value, F.lit(float(max_value)))
        value = F.greatest(value, F.lit(-float(max_value))) if zero_center else value
    out = frame.with_x(x.join(stats, "var_id").select("obs_id", "var_id", value.alias("value")), layer).with_var_cols(stats)
    return out.with_uns(scaled=zero_center)


def pearson_residuals(frame: AnnFrame, theta: float = 100.0, clip: float | None = None, layer: str | None = None) -> DataFrame:
    """Every (obs_id, var_id) with its residual (x - mu) / sqrt(mu + mu^2 / theta), clipped to +-clip (by default sqrt n)."""
    if theta <= 0:
        raise ValueError("theta must be positive")
    if clip is not None and clip < 0:
        raise ValueError("clip must not be negative")
    clip = float(clip) if clip is not None else float(np.sqrt(frame.n_obs))
    x = frame.matrix(layer)
    rows = x.groupBy("obs_id").agg(F.sum("value").alias("r"))
    cols = x.groupBy("var_id").agg(F.sum("value").alias("c"))
    total = F.broadcast(x.agg(F.sum("value").alias("T")))  # one row
    mu = F.col("r") * F.col("c") / F.col("T")
    grid = dense(frame, layer).join(rows, "obs_id", "left").join(cols, "var_id", "left").crossJoin(total).withColumn("mu", F.coalesce(mu, F.lit(0.0)))
    residual = F.when(F.col("mu") > 0, (F.col("value") - F.col("mu")) / F.sqrt(F.col("mu") + F.col("mu") * F.col("mu") / theta)).otherwise(0.0)
    return grid.select("obs_id", "var_id", F.least(F.greatest(residual, F.lit(-clip)), F.lit(clip)).alias("value"))


def normalize_pearson_residuals(frame: AnnFrame, theta: float = 100.0, clip: float | None = None, layer: str | None = None) -> AnnFrame:
    return frame.with_x(pearson_residuals(frame, theta, clip, layer), layer).with_uns(pearson_residuals_normalization={"theta": theta, "clip": clip})


def design(frame: AnnFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """(obs_id, d0, d1, ...), names: 1, numeric covariates, and indicators of string ones but their first value."""
    kinds = dict(frame.obs.dtypes)
    cols, names = [F.lit(1.0)], ["intercept"]
    for key in keys:
        if kinds[key] == "string":
            levels = sorted(r[0] for r in frame.obs.select(key).distinct().collect() if r[0] is not None)
            cols += [F.coalesce((F.col(key) == v).cast("double"), F.lit(0.0)) for v in levels[1:]]
            names += [f"{key}={v}" for v in levels[1:]]
        else:
            cols.append(F.col(key).cast("double"))
            names.append(key)
    return frame.obs.select("obs_id", *[c.alias(f"d{k}") for k, c in enumerate(cols)]), names


def regress_out(frame: AnnFrame, keys: str | list[str], layer: str | None = None) -> AnnFrame:
    """Least-squares residuals of each column on the covariates; least-norm where they are dependent. Dense."""
    d, names = design(frame, [keys] if isinstance(keys, str) else list(keys))
    k = len(names)
    gram = d.agg(*[F.sum(F.col(f"d{i}") * F.col(f"d{j}")).alias(f"g{i}_{j}") for i in range(k) for j in range(k)]).first()
    inverse = np.linalg.pinv(np.array([[gram[f"g{i}_{j}"] for j in range(k)] for i in range(k)]))
    rows = frame.matrix(layer).join(d, "obs_id").groupBy("var_id").agg(*[F.sum(F.col("value") * F.col(f"d{i}")).alias(f"b{i}") for i in range(k)])
    beta = rows.select("var_id", *[sum((F.col(f"b{j}") * float(inverse[i, j]) for j in range(k)), F.lit(0.0)).alias(f"c{i}") for i in range(k)])
    grid = dense(frame, layer).join(d, "obs_id").join(beta, "var_id", "left").fillna(0.0, [f"c{i}" for i in range(k)])
    fitted = sum((F.col(f"d{i}") * F.col(f"c{i}") for i in range(k)), F.lit(0.0))
    return frame.with_x(grid.select("obs_id", "var_id", (F.col("value") - fitted).alias("value")), layer)


def row_normalize(edges: DataFrame) -> DataFrame:
    """Edges with each row's absolute weights summing to 1; rows of zeros stay."""
    rows = edges.groupBy("src").agg(F.sum(F.abs("weight")).alias("_s"))
    return edges.join(rows, "src").select("src", "dst", F.when(F.col("_s") > 0, F.col("weight") / F.col("_s")).otherwise(0.0).alias("weight"))


def l2_normalize(vecs: DataFrame) -> DataFrame:
    """Vectors of length 1; zero vectors stay."""
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v))
    return vecs.withColumn("_n", norm).select("obs_id", F.transform("vec", lambda v: F.when(F.col("_n") > 0, v / F.col("_n")).otherwise(v)).alias("vec"))


def spmm(x: DataFrame, b: DataFrame) -> DataFrame:
    """obs_id, col, value of X B for b (var_id, col, value)."""
    right = b.select("var_id", "col", F.col("value").alias("w"))
    return x.join(right, "var_id").groupBy("obs_id", "col").agg(F.sum(F.col("value") * F.col("w")).alias("value"))
