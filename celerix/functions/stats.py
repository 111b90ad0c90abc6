"""Distributions, corrections and keyed randomness as column functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window as W

_erfc = np.vectorize(math.erfc, otypes=[float])
_lgamma = np.vectorize(math.lgamma, otypes=[float])


@F.pandas_udf(DoubleType())
def normal_sf(z: pd.Series) -> pd.Series:
    """P(Z > z)."""
    return pd.Series(0.5 * _erfc(z.to_numpy(float) / math.sqrt(2)))


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, by modified Lentz steps; elements leave as they settle."""

    def apart(v: np.ndarray) -> np.ndarray:
        return np.where(np.abs(v) > 1e-300, v, 1e-300)

    c, d = np.ones_like(x), 1 / apart(1 - (a + b) * x / (a + 1))
    out, live = d.copy(), np.arange(len(x))
    for m in range(1, 400):
        p, q, z = a[live], b[live], x[live]
        for top in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 / apart(1 + top * d), apart(1 + top / c)
            out[live] *= d * c
        going = np.abs(d * c - 1) >= 1e-15
        if not going.any():
            break
        live, c, d = live[going], c[going], d[going]
    return out


def incomplete_beta(a, b, x) -> np.ndarray:
    """The regularised incomplete beta function of numbers or arrays; 0 below 0 and 1 above 1."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    out = np.where(np.isnan(x), np.nan, (x >= 1).astype(float))
    ok = (x > 0) & (x < 1)
    a, b, x = a[ok], b[ok], x[ok]
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(x) + b * np.log1p(-x))
    low = x < (a + 1) / (a + b + 2)
    p, q, z = np.where(low, a, b), np.where(low, b, a), np.where(low, x, 1 - x)
    part = front * _beta_fraction(p, q, z) / p
    out[ok] = np.where(low, part, 1 - part)
    return out


def student_two_sided(t, df) -> np.ndarray:
    """Two-sided p of numbers or arrays; NaN where t is, and without degrees of freedom."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    df = np.where(df > 0, df, np.nan)
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


@F.pandas_udf(DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t."""
    return pd.Series(student_two_sided(t.to_numpy(float), df.to_numpy(float)))


def bonferroni(p: Column, n: Column) -> Column:
    return F.least(p * n, F.lit(1.0))


def benjamini_hochberg(df: DataFrame, p: str, out: str, by: list[str], tie: str) -> DataFrame:
    """Step-up adjusted p within groups: the running minimum of p n / rank from the largest p down, at most 1."""
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    up = group.orderBy(F.col(p).asc_nulls_last(), tie)
    ranked = df.withColumn("_n", F.count(p).over(group)).withColumn("_q", F.col(p) * F.col("_n") / F.row_number().over(up))
    down = group.orderBy(F.col(p).desc_nulls_first(), F.col(tie).desc()).rowsBetween(W.unboundedPreceding, 0)
    return ranked.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.min("_q").over(down), F.lit(1.0)))).drop("_n", "_q")


def keyed_order(*parts: Column | str) -> Column:
    """A reproducible random key: md5 of the parts joined by |; the same in every engine and partitioning."""
    return F.md5(F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]).cast("binary"))


def permutations(ids: DataFrame, n_perms: int, seed: int) -> DataFrame:
    """perm_id, id, new_id: n_perms random permutations of the ids, by rank of md5(seed | perm_id | id)."""
    base = ids.select(F.col(ids.columns[0]).alias("id"))
    ranked = base.withColumn("pos", F.row_number().over(W.orderBy("id")))
    drawn = base.withColumn("perm_id", F.explode(F.sequence(F.lit(0), F.lit(n_perms - 1))))
    drawn = drawn.withColumn("pos", F.row_number().over(W.partitionBy("perm_id").orderBy(keyed_order(F.lit(seed), "perm_id", "id"), "id")))
    return drawn.join(ranked.select(F.col("id").alias("new_id"), "pos"), "pos").select("perm_id", "id", "new_id")
