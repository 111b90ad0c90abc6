"""Highly variable features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from celerix.frame import AnnFrame
from celerix.operators.transform import moments, pearson_residuals

FLAVORS = ("seurat", "cell_ranger", "seurat_v3", "pearson_residuals")
SPAN = 0.3  # share of the features that a local regression sees


def highly_variable_genes(frame: AnnFrame, n_top_genes: int | None = None, min_mean: float = 0.0125, max_mean: float = 3.0, min_disp: float = 0.5, max_disp: float = float("inf"), n_bins: int = 20, flavor: str = "seurat", layer: str | None = None, subset: bool = False) -> AnnFrame:
    """var gets the flavour's columns; subset keeps the chosen features only."""
    if flavor not in FLAVORS:
        raise ValueError(f"flavor is one of {', '.join(FLAVORS)}")
    if flavor in FLAVORS[2:] and n_top_genes is None:
        raise ValueError(f"{flavor} needs n_top_genes")
    if flavor == "seurat_v3":
        cols = variance_stabilised(frame, n_top_genes, layer)
    elif flavor == "pearson_residuals":
        cols = residual_variance(frame, n_top_genes, layer)
    else:
        cols = dispersions(frame, flavor, n_top_genes, n_bins, min_mean, max_mean, min_disp, max_disp, layer)
    out = frame.with_var_cols(cols)
    return out.where_var("highly_variable") if subset else out


def dispersions(frame: AnnFrame, flavor: str = "seurat", n_top_genes: int | None = None, n_bins: int = 20, min_mean: float = 0.0125, max_mean: float = 3.0, min_disp: float = 0.5, max_disp: float = float("inf"), layer: str | None = None) -> DataFrame:
    """var_id, means, dispersions, dispersions_norm, highly_variable; the bins' limits are one row, everything else stays distributed."""
    got = moments(frame, layer, expm1=flavor == "seurat")
    safe = F.when(F.col("mean") == 0, F.lit(1e-12)).otherwise(F.col("mean"))
    ratio = F.col("var") / safe
    if flavor == "seurat":
        rows = got.select("var_id", F.log1p(safe).alias("means"), F.when(ratio > 0, F.log(ratio)).alias("dispersions"))
        edge = rows.agg(F.min("means").alias("lo"), F.max("means").alias("hi"))
        step = (F.col("hi") - F.col("lo")) / n_bins
        # right-closed bins of equal width, the first closed on both sides
        rows = rows.crossJoin(F.broadcast(edge)).withColumn("bin", sum(((F.col("means") > F.col("lo") + step * k).cast("int") for k in range(1, n_bins)), F.lit(0))).drop("lo", "hi")
        stats = rows.groupBy("bin").agg(F.avg("dispersions").alias("a"), F.stddev_samp("dispersions").alias("d"))
        stats = stats.select("bin", F.when(F.col("d").isNull(), F.lit(0.0)).otherwise(F.col("a")).alias("avg"), F.coalesce("d", "a").alias("dev"))
    else:
        rows = got.select("var_id", safe.alias("means"), ratio.alias("dispersions"))
        edge = rows.agg(F.percentile("means", F.array(*[F.lit(p / 100) for p in range(10, 105, 5)])).alias("e"))
        rows = rows.crossJoin(F.broadcast(edge)).withColumn("bin", F.aggregate("e", F.lit(0), lambda n, e: n + (F.col("means") > e).cast("int"))).drop("e")
        middle = rows.groupBy("bin").agg(F.median("dispersions").alias("avg"))
        stats = rows.join(middle, "bin").groupBy("bin").agg(F.first("avg").alias("avg"), (F.median(F.abs(F.col("dispersions") - F.col("avg"))) * 1.4826).alias("dev"))
    scored = rows.join(F.broadcast(stats), "bin").withColumn("dispersions_norm", (F.col("dispersions") - F.col("avg")) / F.col("dev"))  # one row a bin
    norm = F.when(F.isnan("dispersions_norm"), F.lit(None)).otherwise(F.col("dispersions_norm"))
    scored = scored.withColumn("dispersions_norm", norm)
    if n_top_genes is not None:
        found = [r[0] for r in scored.filter("dispersions_norm is not null").select("dispersions_norm").orderBy(F.desc("dispersions_norm")).limit(n_top_genes).collect()]
        chosen = F.coalesce(F.col("dispersions_norm") >= F.lit(found[-1] if found else float("inf")), F.lit(False))  # ties at the cut are kept
    else:
        d = F.coalesce("dispersions_norm", F.lit(0.0))
        chosen = (F.col("means") > min_mean) & (F.col("means") < max_mean) & (d > min_disp) & (d < max_disp)
    return scored.select("var_id", "means", "dispersions", "dispersions_norm", chosen.alias("highly_variable"))


def _ranked(rows: DataFrame, by: str, n: int) -> DataFrame:
    """highly_variable and highly_variable_rank (0 for the best, null for those not chosen), ties by var_id."""
    best = rows.orderBy(F.desc(by), "var_id").limit(n)
    place = best.select("var_id", (F.row_number().over(W.orderBy(F.desc(by), "var_id")) - 1).alias("highly_variable_rank"))
    return rows.join(place, "var_id", "left").withColumn("highly_variable", F.col("highly_variable_rank").isNotNull())


def residual_variance(frame: AnnFrame, n_top_genes: int, layer: str | None = None) -> DataFrame:
    """var_id, residual_variances, highly_variable, highly_variable_rank."""
    got = pearson_residuals(frame, layer=layer).groupBy("var_id").agg(F.var_samp("value").alias("residual_variances"))
    return _ranked(got, "residual_variances", n_top_genes)


def loess(x: np.ndarray, y: np.ndarray, span: float = SPAN) -> np.ndarray:
    """Local quadratic regression with tricube weights at up to 300 places, interpolated between them."""
    order = np.argsort(x, kind="stable")
    xs, ys = x[order], y[order]
    width = max(4, int(np.ceil(span * len(xs))))
    places = np.unique(np.quantile(xs, np.linspace(0, 1, min(len(xs), 300))))
    fitted = []
    for p in places:
        near = np.argsort(np.abs(xs - p), kind="stable")[:width]
        d = np.abs(xs[near] - p)
        w = np.sqrt((1 - np.minimum(1, d / max(d.max(), 1e-300)) ** 3) ** 3 + 1e-12)
        a = np.stack([np.ones(len(near)), xs[near] - p, (xs[near] - p) ** 2], axis=1)
        fitted.append(np.linalg.lstsq(a * w[:, None], ys[near] * w, rcond=None)[0][0])
    return np.interp(x, places, fitted)


def variance_stabilised(frame: AnnFrame, n_top_genes: int, layer: str | None = None) -> DataFrame:
    """var_id, means, variances, variances_norm, highly_variable, highly_variable_rank on raw counts.

    One figure a feature goes to the driver for the regression; the clipped sums are distributed.
    """
    got = moments(frame, layer)
    n = frame.n_obs
    local = got.filter("var > 0").toPandas()
    spark = frame.x.sparkSession
    sd = np.sqrt(10 ** loess(np.log10(local["mean"].to_numpy()), np.log10(local["var"].to_numpy()))) if len(local) else np.zeros(0)
    table = spark.createDataFrame(local.assign(sd=sd)[["var_id", "sd"]]) if len(local) else spark.createDataFrame([], f"var_id {dict(got.dtypes)['var_id']}, sd double")
    rows = got.join(table, "var_id", "left").fillna(0.0, ["sd"])
    top = rows.select("var_id", (F.col("sd") * float(np.sqrt(n)) + F.col("mean")).alias("top"))
    clipped = frame.matrix(layer).join(top, "var_id").withColumn("v", F.least("value", "top")).groupBy("var_id").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    norm = (F.col("q") - 2 * F.col("mean") * F.col("s") + n * F.col("mean") * F.col("mean")) / ((n - 1) * F.greatest(F.col("sd") * F.col("sd"), F.lit(1e-12)))
    out = rows.join(clipped, "var_id", "left").fillna(0.0, ["s", "q"]).select("var_id", F.col("mean").alias("means"), F.col("var").alias("variances"), F.when(F.col("sd") > 0, norm).otherwise(0.0).alias("variances_norm"))
    return _ranked(out, "variances_norm", n_top_genes)


_OMITTED = object()


def resolve_mask(frame: AnnFrame, mask_var=_OMITTED, use_highly_variable: bool | None = None) -> str | None:
    """Name of the boolean column of var to use, None for all: omitted, `highly_variable` if there is one; None, all."""
    if use_highly_variable is not None:
        import warnings

        if mask_var is not _OMITTED:
            raise ValueError("give mask_var or use_highly_variable, not both")
        warnings.warn("use mask_var", DeprecationWarning, stacklevel=2)
        mask_var = "highly_variable" if use_highly_variable else None
    if mask_var is _OMITTED:
        return "highly_variable" if "highly_variable" in frame.var.columns else None
    if mask_var is None:
        return None
    if mask_var not in frame.var.columns:
        raise ValueError(f"var has no column {mask_var}")
    return mask_var


def masked(frame: AnnFrame, mask: str | None) -> AnnFrame:
    return frame if mask is None else frame.where_var(F.coalesce(F.col(mask).cast("boolean"), F.lit(False)))
