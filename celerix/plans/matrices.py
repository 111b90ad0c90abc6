"""Queries over matrices: quality control, transforms, variable features, markers, scores."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from celerix.functions.stats import benjamini_hochberg, bonferroni
from celerix.operators import features, markers, qc, transform, validation
from celerix.operators.decomposition import simulate_doublets
from celerix.plans import sql
from celerix.plans.registry import query
from celerix.session import cut
from celerix.sources import tables


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """Columns rounded; NaN becomes null, and -0 becomes 0."""
    return df.withColumns({c: F.when(~F.isnan(c), F.round(c, places) + 0.0) for c in columns})


def _r(expression: str, name: str, places: int = 6) -> str:
    return f"round({expression}, {places}) + 0.0 AS {name}"


def lognorm(frame):
    return transform.log1p(transform.normalize_total(frame, 1e4))


@query(f"WITH {sql.DOCUMENTS} SELECT obs.obs_id, coalesce(sum(value), 0.0) AS total_counts, count(value) AS n_genes_by_counts FROM obs LEFT JOIN x USING (obs_id) GROUP BY 1")
def qc_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.per_obs(tables.documents(spark, sf_dir))


@query(f"""WITH {sql.BASKETS}, n AS (SELECT count(*) AS n FROM obs) SELECT var.var_id, coalesce(sum(value), 0.0) AS total_counts, count(value) AS n_cells_by_counts,
{_r("coalesce(sum(value), 0.0) / any_value(n)", "mean_counts")}, {_r("100 * (1 - count(value) / any_value(n))", "pct_dropout_by_counts")} FROM var LEFT JOIN x USING (var_id) CROSS JOIN n GROUP BY 1""")
def qc_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(qc.per_var(tables.baskets(spark, sf_dir)), "mean_counts", "pct_dropout_by_counts")


@query(f"""WITH {sql.BASKETS}, s AS (SELECT obs.obs_id, coalesce(sum(value), 0.0) AS t, count(value) AS n, coalesce(sum(value) FILTER (brand LIKE '%1'), 0.0) AS f
FROM obs LEFT JOIN x USING (obs_id) LEFT JOIN var USING (var_id) GROUP BY 1)
SELECT obs_id, t AS total_counts, n AS n_genes_by_counts, f AS total_counts_one, {_r("CASE WHEN t <> 0 THEN f / t * 100 END", "pct_counts_one")}, {_r("ln(1 + t)", "log1p_total_counts")}, {_r("ln(1 + n)", "log1p_n_genes_by_counts")}, {_r("ln(1 + f)", "log1p_total_counts_one")} FROM s""")
def qc_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = qc.flag_gene_family(tables.baskets(spark, sf_dir), "one", "brand", endswith="1")
    obs, _ = qc.calculate_qc_metrics(frame, ("one",), percent_top=None)
    return rounded(obs, "pct_counts_one", "log1p_total_counts", "log1p_n_genes_by_counts", "log1p_total_counts_one")


@query(f"""WITH {sql.DOCUMENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY value DESC, var_id) AS r FROM x)
SELECT obs.obs_id, {_r("sum(value) FILTER (r <= 5) / sum(value) * 100", "pct_counts_in_top_5_genes")}, {_r("sum(value) FILTER (r <= 50) / sum(value) * 100", "pct_counts_in_top_50_genes")} FROM obs LEFT JOIN r USING (obs_id) GROUP BY 1""")
def qc_percent_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(qc.top_share(tables.documents(spark, sf_dir), (5, 50)), "pct_counts_in_top_5_genes", "pct_counts_in_top_50_genes")


@query(f"""WITH {sql.BASKETS}, s AS (SELECT obs.obs_id, coalesce(sum(value), 0.0) AS n_counts, count(value) AS n_genes FROM obs LEFT JOIN x USING (obs_id) GROUP BY 1)
SELECT obs_id, n_counts, n_genes, count(x.value) AS entries FROM s LEFT JOIN x USING (obs_id) WHERE n_counts >= 1000 AND n_genes BETWEEN 10 AND 560 GROUP BY ALL""")
def filter_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = qc.filter_cells(tables.baskets(spark, sf_dir), min_counts=1000, min_genes=10, max_genes=560)
    return kept.obs.select("obs_id", "n_counts", "n_genes").join(kept.x, "obs_id", "left").groupBy("obs_id", "n_counts", "n_genes").agg(F.count("value").alias("entries"))


@query(f"""WITH {sql.DOCUMENTS} SELECT var_id, sum(value) AS n_counts, count(*) AS n_cells FROM x GROUP BY 1 HAVING count(*) >= 3 AND sum(value) <= 5000""")
def filter_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.filter_genes(tables.documents(spark, sf_dir), min_cells=3, max_counts=5000).var.select("var_id", "n_counts", "n_cells")


@query(f"WITH {sql.DOCUMENTS} SELECT var_id, starts_with(var_id, 'th') AS th, ends_with(var_id, 'ing') AS ing, contains(var_id, 'ea') AS ea FROM var")
def flag_gene_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = tables.documents(spark, sf_dir)
    for name, how in (("th", {"startswith": "th"}), ("ing", {"endswith": "ing"}), ("ea", {"contains": "ea"})):
        frame = qc.flag_gene_family(frame, name, **how)
    return frame.var.select("var_id", "th", "ing", "ea")


@query(f"""WITH {sql.BASKETS}, t AS (SELECT obs.obs_id, coalesce(sum(value), 0.0) AS t FROM obs LEFT JOIN x USING (obs_id) GROUP BY 1), g AS (SELECT median(t) AS g FROM t)
SELECT x.obs_id, x.var_id, {_r("ln(1 + value * (g / t))", "value")} FROM x JOIN t USING (obs_id) CROSS JOIN g WHERE t > 0""")
def normalize_log1p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(transform.log1p(transform.normalize_total(tables.baskets(spark, sf_dir))).x, "value")


@query(f"""WITH {sql.DOCUMENTS}, {sql.LOGNORM}, n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM obs), s AS (SELECT var_id, sum(exp(value) - 1) AS t, sum((exp(value) - 1) * (exp(value) - 1)) AS q FROM ln GROUP BY 1)
SELECT var_id, {_r("t / n", "mean", 5)}, {_r("(q - n * (t / n) * (t / n)) / (n - 1)", "var", 3)} FROM s CROSS JOIN n""")
def gene_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = transform.moments(lognorm(tables.documents(spark, sf_dir)), expm1=True)
    return rounded(rounded(got, "mean", places=5), "var", places=3)


@query(f"""WITH {sql.EVENTS}, n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM obs), m AS (SELECT var_id, sum(value) / any_value(n) AS mean, sqrt((sum(value * value) - any_value(n) * (sum(value) / any_value(n)) * (sum(value) / any_value(n))) / (any_value(n) - 1)) AS sd FROM x CROSS JOIN n GROUP BY 1),
g AS (SELECT obs_id, var_id, coalesce(value, 0.0) AS value FROM (SELECT obs_id, var_id FROM obs CROSS JOIN var) LEFT JOIN x USING (obs_id, var_id))
SELECT obs_id, var_id, {_r("greatest(least((value - mean) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 1.5), -1.5)", "value")} FROM g JOIN m USING (var_id)""")
def scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(transform.scale(tables.events(spark, sf_dir), max_value=1.5).x, "value")


@query(f"""WITH {sql.EVENTS}, r AS (SELECT obs_id, sum(value) AS r FROM x GROUP BY 1), c AS (SELECT var_id, sum(value) AS c FROM x GROUP BY 1), t AS (SELECT sum(value) AS t FROM x), n AS (SELECT count(*) AS n FROM obs),
g AS (SELECT obs_id, var_id, coalesce(value, 0.0) AS value FROM (SELECT obs_id, var_id FROM obs CROSS JOIN var) LEFT JOIN x USING (obs_id, var_id)),
m AS (SELECT obs_id, var_id, value, r * c / t AS mu FROM g JOIN r USING (obs_id) JOIN c USING (var_id) CROSS JOIN t)
SELECT obs_id, var_id, {_r("greatest(least((value - mu) / sqrt(mu + mu * mu / 100), sqrt(n)), -sqrt(n))", "value")} FROM m CROSS JOIN n""")
def pearson_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(transform.pearson_residuals(tables.events(spark, sf_dir)), "value")


@query(f"""WITH {sql.EVENTS}, g AS (SELECT obs_id, var_id, coalesce(value, 0.0) AS value, CAST(obs_id % 7 AS DOUBLE) AS c FROM (SELECT obs_id, var_id FROM obs CROSS JOIN var) LEFT JOIN x USING (obs_id, var_id)),
f AS (SELECT var_id, regr_slope(value, c) AS b, regr_intercept(value, c) AS a FROM g GROUP BY 1)
SELECT obs_id, var_id, {_r("value - (a + b * c)", "value")} FROM g JOIN f USING (var_id)""")
def regress_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = tables.events(spark, sf_dir)
    frame = frame.with_obs_cols(frame.obs.select("obs_id", (F.col("obs_id") % 7).cast("double").alias("c")))
    return rounded(transform.regress_out(frame, "c").x, "value")


_SEURAT = f"""{sql.DOCUMENTS}, {sql.LOGNORM}, n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM obs), s AS (SELECT var_id, sum(exp(value) - 1) / any_value(n) AS m, (sum((exp(value) - 1) * (exp(value) - 1)) - any_value(n) * (sum(exp(value) - 1) / any_value(n)) * (sum(exp(value) - 1) / any_value(n))) / (any_value(n) - 1) AS v FROM ln CROSS JOIN n GROUP BY 1),
d AS (SELECT var_id, ln(1 + m) AS means, CASE WHEN v / m > 0 THEN ln(v / m) END AS disp FROM s), e AS (SELECT min(means) AS lo, max(means) AS hi FROM d),
b AS (SELECT var_id, means, disp, list_sum([CASE WHEN means > lo + (hi - lo) / 20 * k THEN 1 ELSE 0 END FOR k IN range(1, 20)]) AS bin FROM d CROSS JOIN e),
z AS (SELECT bin, CASE WHEN stddev_samp(disp) IS NULL THEN 0 ELSE avg(disp) END AS a, coalesce(stddev_samp(disp), avg(disp)) AS dev FROM b GROUP BY 1),
h AS (SELECT var_id, means, disp, (disp - a) / dev AS norm FROM b JOIN z USING (bin))"""


@query(f"""WITH {_SEURAT} SELECT var_id, {_r("means", "means")}, {_r("disp", "dispersions")}, {_r("norm", "dispersions_norm", 4)}, (means > 0.0125 AND means < 3 AND coalesce(norm, 0) > 0.5) AS highly_variable FROM h""")
def hvg_seurat(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = features.dispersions(lognorm(tables.documents(spark, sf_dir)))
    return rounded(rounded(got, "means", "dispersions"), "dispersions_norm", places=4)


@query(f"""WITH {_SEURAT} SELECT var_id, {_r("norm", "dispersions_norm", 4)} FROM h WHERE norm IS NOT NULL ORDER BY round(norm, 4) DESC, var_id LIMIT 20""")
def top_variable_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = rounded(features.dispersions(lognorm(tables.documents(spark, sf_dir))), "dispersions_norm", places=4)
    return got.filter("dispersions_norm is not null").orderBy(F.desc("dispersions_norm"), "var_id").limit(20).select("var_id", "dispersions_norm")


@query(f"""WITH {sql.BASKETS}, {sql.LOGNORM}, n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM obs), s AS (SELECT var.var_id, coalesce(sum(value), 0) / any_value(n) AS m, (coalesce(sum(value * value), 0) - any_value(n) * (coalesce(sum(value), 0) / any_value(n)) * (coalesce(sum(value), 0) / any_value(n))) / (any_value(n) - 1) AS v FROM var LEFT JOIN ln USING (var_id) CROSS JOIN n GROUP BY 1),
d AS (SELECT var_id, CASE WHEN m = 0 THEN 1e-12 ELSE m END AS means, v / CASE WHEN m = 0 THEN 1e-12 ELSE m END AS disp FROM s),
e AS (SELECT quantile_cont(means, [0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0]) AS e FROM d),
b AS (SELECT var_id, means, disp, list_sum([CASE WHEN round(means, 9) > round(k, 9) THEN 1 ELSE 0 END FOR k IN e]) AS bin FROM d CROSS JOIN e),
c AS (SELECT bin, median(disp) AS a FROM b GROUP BY 1), z AS (SELECT bin, any_value(a) AS a, median(abs(disp - a)) * 1.4826 AS dev FROM b JOIN c USING (bin) GROUP BY 1)
SELECT var_id, {_r("means", "means")}, {_r("disp", "dispersions")} FROM b JOIN z USING (bin)""")
def hvg_cell_ranger(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = features.dispersions(lognorm(tables.baskets(spark, sf_dir)), "cell_ranger", n_top_genes=100)
    return rounded(got.select("var_id", "means", "dispersions"), "means", "dispersions")


@query(f"""WITH {sql.EVENTS}, r AS (SELECT obs_id, sum(value) AS r FROM x GROUP BY 1), c AS (SELECT var_id, sum(value) AS c FROM x GROUP BY 1), t AS (SELECT sum(value) AS t FROM x), n AS (SELECT count(*) AS n FROM obs),
g AS (SELECT obs_id, var_id, coalesce(value, 0.0) AS value FROM (SELECT obs_id, var_id FROM obs CROSS JOIN var) LEFT JOIN x USING (obs_id, var_id)),
m AS (SELECT obs_id, var_id, value, r * c / t AS mu FROM g JOIN r USING (obs_id) JOIN c USING (var_id) CROSS JOIN t),
v AS (SELECT var_id, var_samp(greatest(least((value - mu) / sqrt(mu + mu * mu / 100), sqrt(n)), -sqrt(n))) AS rv FROM m CROSS JOIN n GROUP BY 1),
k AS (SELECT *, row_number() OVER (ORDER BY rv DESC, var_id) AS p FROM v)
SELECT var_id, {_r("rv", "residual_variances")}, p <= 3 AS highly_variable, CASE WHEN p <= 3 THEN CAST(p - 1 AS BIGINT) END AS highly_variable_rank FROM k""")
def hvg_pearson_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = features.residual_variance(tables.events(spark, sf_dir), 3)
    return rounded(got, "residual_variances").select("var_id", "residual_variances", "highly_variable", F.col("highly_variable_rank").cast("long").alias("highly_variable_rank"))


@query()
def hvg_seurat_v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.variance_stabilised(tables.baskets(spark, sf_dir), 200), "means", "variances", "variances_norm")


_GROUPS = f"""{sql.BASKETS}, {sql.LOGNORM}, sz AS (SELECT grp, count(*) AS n FROM obs GROUP BY 1),
gs AS (SELECT grp, var_id, sum(value) AS s, sum(value * value) AS q FROM ln JOIN obs USING (obs_id) GROUP BY 1, 2),
a AS (SELECT grp, n, var_id, coalesce(s, 0.0) AS s, coalesce(q, 0.0) AS q FROM (SELECT grp, n, var_id FROM sz CROSS JOIN var) LEFT JOIN gs USING (grp, var_id)),
w AS (SELECT var_id, sum(n) AS tn, sum(s) AS ts, sum(q) AS tq FROM a GROUP BY 1),
m AS (SELECT grp, var_id, n, tn - n AS rn, s / n AS m, (ts - s) / (tn - n) AS r, greatest((q / n - (s / n) * (s / n)) * n / (n - 1), 0) AS va, greatest(((tq - q) / (tn - n) - ((ts - s) / (tn - n)) * ((ts - s) / (tn - n))) * (tn - n) / (tn - n - 1), 0) AS vb FROM a JOIN w USING (var_id))"""


def _marker_sql(second: str) -> str:
    return f"""WITH {_GROUPS} SELECT grp AS "group", var_id, {_r(f"CASE WHEN va / n + vb / {second} > 0 THEN (m - r) / sqrt(va / n + vb / {second}) ELSE 0 END", "scores", 4)}, {_r("log2((exp(m) - 1 + 1e-9) / (exp(r) - 1 + 1e-9))", "logfoldchanges", 4)} FROM m"""


def _markers(spark: SparkSession, sf_dir: str, method: str, **kw) -> DataFrame:
    got = markers.rank_genes_groups(lognorm(tables.baskets(spark, sf_dir)), "grp", method, with_p=False, **kw)
    return rounded(got.select("group", "var_id", "scores", "logfoldchanges"), "scores", "logfoldchanges", places=4)


@query(_marker_sql("rn"))
def rank_genes_ttest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _markers(spark, sf_dir, "t-test")


@query(_marker_sql("n"))
def rank_genes_ttest_overestim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _markers(spark, sf_dir, "t-test_overestim_var")


_RANKS = f"""{sql.BASKETS}, n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM obs), g AS (SELECT obs_id, grp, var_id, coalesce(value, 0.0) AS value FROM (SELECT obs_id, grp, var_id FROM obs CROSS JOIN var) LEFT JOIN x USING (obs_id, var_id)),
k AS (SELECT grp, var_id, rank() OVER (PARTITION BY var_id ORDER BY value) + (count(*) OVER (PARTITION BY var_id, value) - 1) / 2.0 AS r FROM g),
ties AS (SELECT var_id, sum(t * t * t - t) AS t FROM (SELECT var_id, value, CAST(count(*) AS DOUBLE) AS t FROM g GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT grp, var_id, sum(r) AS r, CAST(count(*) AS DOUBLE) AS c FROM k GROUP BY 1, 2)"""


@query(f"""WITH {_RANKS} SELECT grp AS "group", var_id, {_r("(r - c * (n + 1) / 2) / (sqrt(c * (n - c) * (n + 1) / 12) + 1e-12)", "scores")} FROM s CROSS JOIN n""")
def rank_genes_wilcoxon(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = tables.baskets(spark, sf_dir)
    return rounded(markers.wilcoxon(frame.x, frame.obs, frame.var, "grp").select("group", "var_id", "score").withColumnRenamed("score", "scores"), "scores")


@query(f"""WITH {_RANKS} SELECT grp AS "group", var_id, {_r("CASE WHEN 1 - t / (n * n * n - n) > 1e-12 THEN (r - c * (n + 1) / 2) / (sqrt(c * (n - c) * (n + 1) / 12 * (1 - t / (n * n * n - n))) + 1e-12) ELSE 0 END", "scores")} FROM s JOIN ties USING (var_id) CROSS JOIN n""")
def rank_genes_wilcoxon_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = tables.baskets(spark, sf_dir)
    return rounded(markers.wilcoxon(frame.x, frame.obs, frame.var, "grp", tie_correct=True).select("group", "var_id", F.col("score").alias("scores")), "scores")


@query()
def rank_genes_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = markers.rank_genes_groups(lognorm(tables.baskets(spark, sf_dir)), "grp")
    return rounded(markers.filter_markers(got, max_p_adj=0.9), "scores", "pvals", "pvals_adj", "logfoldchanges")


@query()
def rank_genes_logreg(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = lognorm(tables.events(spark, sf_dir))
    frame = frame.with_obs_cols(frame.obs.select("obs_id", (F.col("obs_id") % 3).cast("string").alias("grp")))
    return rounded(markers.rank_genes_groups(frame, "grp", "logreg"), "scores")


_SCORE = f"""{sql.BASKETS}, n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM obs), mean AS (SELECT var.var_id, coalesce(sum(value), 0.0) / any_value(n) AS m FROM var LEFT JOIN x USING (var_id) CROSS JOIN n GROUP BY 1),
items AS (SELECT greatest(CAST(round_even(count(*) / 24.0, 0) AS BIGINT), 1) AS k FROM var), bins AS (SELECT var_id, floor(rank() OVER (ORDER BY m) / k) AS bin FROM mean CROSS JOIN items),
genes AS (SELECT var_id FROM var WHERE brand = 'Brand#11'), used AS (SELECT DISTINCT bin FROM bins JOIN genes USING (var_id)),
pool AS (SELECT var_id, row_number() OVER (PARTITION BY bin ORDER BY md5(concat_ws('|', '0', CAST(var_id AS VARCHAR))), var_id) AS r FROM bins JOIN used USING (bin)),
ctrl AS (SELECT var_id FROM pool WHERE r <= 10 AND var_id NOT IN (SELECT var_id FROM genes)),
w AS (SELECT var_id, 1.0 / (SELECT count(*) FROM genes) AS w FROM genes UNION ALL SELECT var_id, -1.0 / (SELECT count(*) FROM ctrl) FROM ctrl)"""


@query(f"""WITH {_SCORE} SELECT obs.obs_id, {_r("coalesce(s, 0.0)", "score")} FROM obs LEFT JOIN (SELECT obs_id, sum(value * w) AS s FROM x JOIN w USING (var_id) GROUP BY 1) USING (obs_id)""")
def score_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = tables.baskets(spark, sf_dir)
    return rounded(markers.score_genes(frame, frame.var.filter("brand = 'Brand#11'"), ctrl_size=10), "score")


def _scored(tag: str, brand: str) -> str:
    """The tables of _SCORE after bins, for the genes of a brand, and s_{tag}: obs_id, score."""
    part = _SCORE[_SCORE.index("genes AS") :].replace("Brand#11", brand)
    for name in ("genes", "used", "pool", "ctrl"):
        part = re.sub(rf"\b{name}\b", f"{name}_{tag}", part)
    part = re.sub(r"\bw AS \(", f"w_{tag} AS (", part)
    return part + f", s_{tag} AS (SELECT obs.obs_id, coalesce(s, 0.0) AS score FROM obs LEFT JOIN (SELECT obs_id, sum(value * w) AS s FROM x JOIN w_{tag} USING (var_id) GROUP BY 1) USING (obs_id))"


@query(f"""WITH {_SCORE[: _SCORE.index("genes AS")]}{_scored("s", "Brand#11")}, {_scored("g", "Brand#12")}
SELECT a.obs_id, {_r("a.score", "S_score")}, {_r("b.score", "G2M_score")}, CASE WHEN a.score < 0 AND b.score < 0 THEN 'G1' WHEN a.score >= b.score THEN 'S' ELSE 'G2M' END AS phase FROM s_s a JOIN s_g b USING (obs_id)""")
def score_cell_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = tables.baskets(spark, sf_dir)
    got = markers.score_genes_cell_cycle(frame, frame.var.filter("brand = 'Brand#11'"), frame.var.filter("brand = 'Brand#12'"), ctrl_size=10)
    return rounded(got, "S_score", "G2M_score")


_P = "SELECT o_orderkey AS id, o_orderpriority AS grp, ((o_orderkey * 7919) % 1009 + 1) / 1010.0 AS p FROM orders"


@query(f"""WITH a AS ({_P}), r AS (SELECT *, count(*) OVER (PARTITION BY grp) AS n, row_number() OVER (PARTITION BY grp ORDER BY p, id) AS k FROM a), q AS (SELECT *, p * n / k AS q FROM r)
SELECT id, grp, {_r("least(min(q) OVER (PARTITION BY grp ORDER BY p DESC, id DESC ROWS UNBOUNDED PRECEDING), 1.0)", "q")}, {_r("least(p * n, 1.0)", "bonferroni")} FROM q""")
def adjusted_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window as W

    p = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("grp"), (((F.col("o_orderkey") * 7919) % 1009 + 1) / 1010.0).alias("p"))
    p = benjamini_hochberg(p, "p", "q", ["grp"], "id").withColumn("bonferroni", bonferroni(F.col("p"), F.count("p").over(W.partitionBy("grp"))))
    return rounded(p.select("id", "grp", "q", "bonferroni"), "q", "bonferroni")


def _draw_sql(side: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', '0', '{side}', CAST(i AS VARCHAR))), 1, 15) AS BIGINT) % (SELECT count(*) FROM obs)"


@query(f"""WITH {sql.EVENTS}, p AS (SELECT obs_id, row_number() OVER (ORDER BY obs_id) - 1 AS pos FROM obs), s AS (SELECT i, {_draw_sql("a")} AS a, {_draw_sql("b")} AS b FROM range(300) t(i)),
e AS (SELECT i, unnest([a, b]) AS pos FROM s) SELECT i AS sim_id, var_id, sum(value) AS value FROM e JOIN p USING (pos) JOIN x USING (obs_id) GROUP BY 1, 2""")
def simulated_doublets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate_doublets(tables.events(spark, sf_dir), 300)[0]


@query(f"""WITH {sql.DOCUMENTS} SELECT source AS label, count(*) AS n FROM obs GROUP BY 1""")
def label_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.label_sizes(tables.documents(spark, sf_dir), "source")


@query(f"""WITH {sql.BASKETS}, kept AS (SELECT obs_id FROM obs WHERE grp IN ('1', '2')), vv AS (SELECT var_id FROM var WHERE type LIKE 'S%')
SELECT obs_id, sum(value) AS total_counts FROM x JOIN kept USING (obs_id) JOIN vv USING (var_id) GROUP BY 1""")
def row_and_column_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = tables.baskets(spark, sf_dir).where_obs("grp in ('1', '2')").where_var("type like 'S%'")
    return part.x.groupBy("obs_id").agg(F.sum("value").alias("total_counts"))


@query(f"""WITH {sql.BASKETS}, b AS (SELECT p_partkey AS var_id, p_size % 5 AS col, CAST(p_size AS DOUBLE) AS w FROM part) SELECT obs_id, CAST(col AS INTEGER) AS col, sum(value * w) AS value FROM x JOIN b USING (var_id) GROUP BY 1, 2""")
def sparse_times_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = tables.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("var_id"), (F.col("p_size") % 5).cast("int").alias("col"), F.col("p_size").cast("double").alias("value"))
    return transform.spmm(tables.baskets(spark, sf_dir).x, b)


@query(f"""WITH {sql.VECTORS}, p AS (SELECT obs_id, cluster, px, py FROM pts JOIN obs USING (obs_id)),
s AS (SELECT cluster, count(*) AS n, var_samp(px) * pow(count(*), -1.0 / 3) AS a, covar_samp(px, py) * pow(count(*), -1.0 / 3) AS b, var_samp(py) * pow(count(*), -1.0 / 3) AS c FROM p GROUP BY 1),
d AS (SELECT u.obs_id, u.cluster, sum(exp(-0.5 * (c * (u.px - v.px) * (u.px - v.px) - 2 * b * (u.px - v.px) * (u.py - v.py) + a * (u.py - v.py) * (u.py - v.py)) / (a * c - b * b))) AS k FROM p u JOIN p v ON u.cluster = v.cluster JOIN s ON s.cluster = u.cluster GROUP BY 1, 2)
SELECT obs_id, cluster AS "group", {_r("(k - min(k) OVER (PARTITION BY cluster)) / (max(k) OVER (PARTITION BY cluster) - min(k) OVER (PARTITION BY cluster) + 1e-300)", "density", 5)} FROM d""")
def embedding_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(markers.embedding_density(tables.vectors(spark, sf_dir), "spatial", "cluster"), "density", places=5)


@query(f"""WITH {sql.BASKETS}, l AS (SELECT DISTINCT CAST(nation AS VARCHAR) AS label FROM obs)
SELECT label, CAST(row_number() OVER (ORDER BY CASE WHEN regexp_full_match(label, '[0-9]+') THEN CAST(label AS DECIMAL(38, 0)) END NULLS LAST, label) - 1 AS INTEGER) AS code FROM l""")
def natural_label_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = tables.baskets(spark, sf_dir)
    return qc.natural_order(cut(frame.obs.select(F.col("nation").cast("string").alias("nation"))), "nation")


@query(f"""WITH {sql.BASKETS} SELECT count(*) AS n, min(value) AS least, max(value) AS greatest, {_r("avg(value)", "mean")}, {_r("sqrt(sum(value * value))", "l2", 3)}, CAST(0 AS BIGINT) AS n_odd FROM x""")
def matrix_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(validation.fingerprint(tables.baskets(spark, sf_dir).x), "mean"), "l2", places=3)


@query(f"""WITH {sql.BASKETS}, p AS (SELECT value AS y, value + (var_id % 3) * 0.5 AS x FROM x) SELECT count(*) AS n, {_r("max(abs(x - y))", "max_abs")}, {_r("max(abs(x - y) / greatest(abs(y), 1e-12))", "max_rel")},
{_r("sqrt(avg((x - y) * (x - y)))", "rmse")}, {_r("corr(x, y)", "pearson")}, bool_and(abs(x - y) <= 1e-8 + 1e-5 * abs(y)) AS close FROM p""")
def compared_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = tables.baskets(spark, sf_dir).x
    other = x.withColumn("value", F.col("value") + (F.col("var_id") % 3) * 0.5)
    return rounded(validation.compare(other, x, ["obs_id", "var_id"]), "max_abs", "max_rel", "rmse", "pearson")
