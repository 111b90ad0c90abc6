import math

import numpy as np
import pytest
from celerix.functions import stats
from celerix.operators import features, markers, qc, transform
from celerix.operators.decomposition import threshold_minimum
from celerix.operators.layout import find_ab, packed_discs, perplexity_rows
from pyspark.sql import functions as F

from celerix.frame import AnnFrame, value_matrix


def frame_of(spark, x, groups=None):
    """Dense numpy to AnnFrame; obs_id and var_id count from 0."""
    n, g = x.shape
    rows = [(int(i), int(j), float(x[i, j])) for i in range(n) for j in range(g) if x[i, j]]
    obs = spark.createDataFrame([(i, str(groups[i]) if groups is not None else "a") for i in range(n)], "obs_id long, grp string")
    var = spark.createDataFrame([(j, f"g{j}") for j in range(g)], "var_id long, name string")
    return AnnFrame(obs, var, spark.createDataFrame(rows, "obs_id long, var_id long, value double"))


@pytest.fixture(scope="module")
def counts():
    x = np.random.default_rng(0).poisson(2, (60, 30)).astype(float)
    x[0] = 0
    return x


def test_student_and_normal(spark):
    assert math.isclose(stats.student_two_sided(2.0, 10), 0.07338803477074, rel_tol=1e-9)
    assert math.isclose(stats.student_two_sided(-1.5, 3.5), stats.student_two_sided(1.5, 3.5))
    assert math.isclose(stats.incomplete_beta(2, 3, 0.4), 0.5248, rel_tol=1e-12)
    t = stats.student_two_sided(np.array([2.0, np.nan, np.inf, 0.0, 2.0]), np.array([10.0, 3, 3, 3, -1]))
    assert np.allclose(t, [0.07338803477074, np.nan, 0, 1, np.nan], rtol=1e-9, equal_nan=True)
    x = np.linspace(-0.1, 1.1, 50)  # a = 1, b = 4: 1 - (1 - x)^4
    assert np.allclose(stats.incomplete_beta(1, 4, x), 1 - (1 - x.clip(0, 1)) ** 4, atol=1e-14)
    none = spark.createDataFrame([(2.0, 10.0), (None, 3.0)], "t double, df double").select(stats.student_p("t", "df")).collect()
    assert math.isclose(none[0][0], 0.07338803477074, rel_tol=1e-9) and (none[1][0] is None or math.isnan(none[1][0]))
    z = spark.createDataFrame([(1.959963984540054,), (0.0,)], "z double").select(stats.normal_sf("z")).collect()
    assert math.isclose(z[0][0], 0.025, rel_tol=1e-9) and z[1][0] == 0.5


def test_bh_against_numpy(spark):
    p = np.random.default_rng(1).random(40) ** 2
    df = spark.createDataFrame([(int(k), float(v)) for k, v in enumerate(p)], "id long, p double")
    got = {r["id"]: r["q"] for r in stats.benjamini_hochberg(df, "p", "q", [], "id").collect()}
    order = np.argsort(p)
    q = np.minimum(1, np.minimum.accumulate((p[order] * 40 / np.arange(1, 41))[::-1])[::-1])
    assert np.allclose([got[int(k)] for k in order], q, rtol=1e-12)


def test_empty_row_is_undefined_and_bounds_are_inclusive(spark, counts):
    frame = qc.flag_gene_family(frame_of(spark, counts), "one", "name", startswith="g1")
    obs, var = qc.calculate_qc_metrics(frame, ("one",), percent_top=(5,))
    row = obs.filter("obs_id = 0").first()
    assert row["total_counts"] == 0 and math.isnan(row["pct_counts_one"]) and math.isnan(row["pct_counts_in_top_5_genes"])
    assert set(var.columns) == {"var_id", "total_counts", "n_cells_by_counts", "mean_counts", "pct_dropout_by_counts", "log1p_total_counts", "log1p_mean_counts"}
    least = counts.sum(1)[1:].min()
    assert qc.filter_cells(frame, min_counts=float(least)).n_obs == 59
    with pytest.raises(IndexError):
        qc.top_share(frame, (31,))
    with pytest.raises(ValueError):
        qc.filter_genes(frame)


def test_scale_and_regress_against_numpy(spark, counts):
    frame = frame_of(spark, counts)
    frame = frame.with_obs_cols(frame.obs.select("obs_id", (F.col("obs_id") % 3).cast("string").alias("b"), F.col("obs_id").cast("double").alias("t"), F.lit(0.0).alias("zero")))
    got = transform.scale(frame, max_value=2).x.toPandas().pivot(index="obs_id", columns="var_id", values="value").to_numpy()
    want = np.clip((counts - counts.mean(0)) / counts.std(0, ddof=1), -2, 2)
    assert np.allclose(got, want)
    d = np.stack([np.ones(60), np.arange(60) % 3 == 1, np.arange(60) % 3 == 2, np.arange(60), np.zeros(60)], axis=1).astype(float)
    want = counts - d @ np.linalg.lstsq(d, counts, rcond=None)[0]
    got = transform.regress_out(frame, ["b", "t", "zero"]).x.toPandas().pivot(index="obs_id", columns="var_id", values="value").to_numpy()
    assert np.allclose(got, want, atol=1e-8)


def test_dispersion_bins_against_pandas(spark):
    import pandas as pd

    x = np.random.default_rng(3).poisson(np.random.default_rng(4).gamma(1, 2, 50), (80, 50)).astype(float)
    frame = transform.log1p(transform.normalize_total(frame_of(spark, x), 1e4))
    got = features.dispersions(frame).toPandas().sort_values("var_id")
    e = np.zeros_like(x)
    total = x.sum(1, keepdims=True)
    e = x / np.where(total == 0, 1, total) * 1e4
    mean, var = e.mean(0), e.var(0, ddof=1)
    disp = np.log(np.where(var > 0, var / np.where(mean == 0, 1e-12, mean), np.nan))
    df = pd.DataFrame({"m": np.log1p(mean), "d": disp})
    df["bin"] = pd.cut(df.m, 20)
    g = df.groupby("bin", observed=True).d.agg(["mean", "std"])
    one = g["std"].isna()
    g.loc[one, "std"], g.loc[one, "mean"] = g.loc[one, "mean"], 0
    z = (df.d - df.bin.map(g["mean"]).astype(float)) / df.bin.map(g["std"]).astype(float)
    assert np.allclose(got.dispersions_norm.astype(float), z, atol=1e-6, equal_nan=True)
    top = features.dispersions(frame, n_top_genes=7)
    assert top.filter("highly_variable").count() >= 7
    with pytest.raises(ValueError):
        features.highly_variable_genes(frame, flavor="seurat_v3_paper")


def test_markers_find_planted_features(spark, counts):
    groups = np.arange(60) % 3
    x = counts.copy()
    x[groups == 1, 4] += 9
    frame = transform.log1p(frame_of(spark, x, groups))
    for method in ("t-test", "wilcoxon", "t-test_overestim_var"):
        best = markers.rank_genes_groups(frame, "grp", method).filter("`group` = '1' and rank = 1").first()
        assert best["var_id"] == 4 and best["pvals_adj"] < 1e-3 and best["logfoldchanges"] > 0
    vs = markers.rank_genes_groups(frame, "grp", "wilcoxon", reference="0")
    assert {r[0] for r in vs.select("group").distinct().collect()} == {"1", "2"}
    a, b = np.log1p(x)[groups == 1, 4], np.log1p(x)[groups != 1, 4]
    t = (a.mean() - b.mean()) / math.sqrt(a.var(ddof=1) / len(a) + b.var(ddof=1) / len(b))
    got = markers.rank_genes_groups(frame, "grp").filter("`group` = '1' and var_id = 4").first()
    assert math.isclose(got["scores"], t, rel_tol=1e-9)
    with pytest.raises(ValueError):
        markers.rank_genes_groups(frame, "grp", "u-test")
    with pytest.raises(ValueError):
        markers.rank_genes_groups(frame, "grp", reference="9")
    assert markers.rank_genes_groups(frame, "grp", "logreg").filter("`group` = '1' and rank = 1").first()["var_id"] == 4


def test_threshold_between_two_peaks():
    rng = np.random.default_rng(0)
    both = np.concatenate([rng.normal(0.2, 0.05, 3000), rng.normal(0.7, 0.05, 1500)])
    assert 0.3 < threshold_minimum(both) < 0.6 and threshold_minimum(np.array([])) is None


def test_curve_discs_and_perplexity():
    a, b = find_ab(1.0, 0.5)
    assert abs(a - 0.5830) < 0.01 and abs(b - 1.3342) < 0.01
    centres, radii = packed_discs(np.array([400, 20, 20, 300, 5, 5, 5]), 2)
    gap = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2)) - radii[:, None] - radii[None]
    assert gap[~np.eye(7, dtype=bool)].min() > -1e-9 and radii.min() >= 0.4
    p = perplexity_rows(np.random.default_rng(0).random((50, 40)), 10)
    assert np.allclose(np.exp(-(p * np.log(p)).sum(1)), 10, rtol=1e-3)


def test_value_matrix_sums_repeats(spark):
    x = spark.createDataFrame([(1, 1, 2.0), (1, 1, -2.0), (1, 2, 1.0)], "obs_id long, var_id long, value double")
    frame = value_matrix(x.select("obs_id").distinct(), x.select("var_id").distinct(), x)
    assert [tuple(r) for r in frame.x.collect()] == [(1, 2, 1.0)]
