"""Group statistics: marker tests, set scores, density."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from celerix.frame import AnnFrame
from celerix.functions.stats import benjamini_hochberg, keyed_order, normal_sf, student_p

METHODS = ("t-test", "t-test_overestim_var", "wilcoxon", "logreg")
TINY = 1e-9


def group_moments(x: DataFrame, obs: DataFrame, var: DataFrame, groupby: str) -> DataFrame:
    """group, var_id, n, s, q: size of the group, sum and sum of squares, for every pair (absent ones are 0)."""
    labels = obs.filter(F.col(groupby).isNotNull()).select("obs_id", F.col(groupby).cast("string").alias("group"))
    sizes = labels.groupBy("group").agg(F.count("*").alias("n"))
    sums = x.join(labels, "obs_id").groupBy("group", "var_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    return sizes.crossJoin(var.select("var_id")).join(sums, ["group", "var_id"], "left").fillna(0.0, ["s", "q"])  # a row for each group of each column


def _against(moments: DataFrame, reference: str) -> DataFrame:
    """Adds rn, rs, rq of the rest, or of the reference group, which then goes."""
    if reference == "rest":
        whole = moments.groupBy("var_id").agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"), F.sum("q").alias("tq"))
        return moments.join(whole, "var_id").withColumn("rn", F.col("tn") - F.col("n")).withColumn("rs", F.col("ts") - F.col("s")).withColumn("rq", F.col("tq") - F.col("q")).drop("tn", "ts", "tq")
    other = moments.filter(F.col("group") == reference).select("var_id", F.col("n").alias("rn"), F.col("s").alias("rs"), F.col("q").alias("rq"))
    return moments.filter(F.col("group") != reference).join(other, "var_id")


def _fold(base: float | None = None):
    up = lambda m: F.expm1(m) if base is None else F.expm1(m * math.log(base))
    return lambda a, b: F.log2((up(a) + TINY) / (up(b) + TINY))


def welch(moments: DataFrame, overestimate: bool = False) -> DataFrame:
    """score (t), df, logfc from sums; a score that is undefined is 0."""
    m, r = F.col("s") / F.col("n"), F.col("rs") / F.col("rn")
    v = F.greatest((F.col("q") / F.col("n") - m * m) * F.col("n") / (F.col("n") - 1), F.lit(0.0))
    w = F.greatest((F.col("rq") / F.col("rn") - r * r) * F.col("rn") / (F.col("rn") - 1), F.lit(0.0))
    n2 = F.col("n") if overestimate else F.col("rn")
    rows = moments.withColumn("va", v / F.col("n")).withColumn("vb", w / n2)
    se = F.sqrt(F.col("va") + F.col("vb"))
    df = (F.col("va") + F.col("vb")) * (F.col("va") + F.col("vb")) / (F.col("va") * F.col("va") / (F.col("n") - 1) + F.col("vb") * F.col("vb") / (n2 - 1))
    return rows.withColumn("score", F.when(se > 0, (m - r) / se).otherwise(0.0)).withColumn("df", F.when(se > 0, df)).withColumn("logfc", _fold()(m, r))


def average_ranks(x: DataFrame, n: int) -> DataFrame:
    """x with rank: the average-tie rank of each stored value in its column of n values, zeros included, and the column's zero_rank."""
    sums = x.groupBy("var_id").agg(F.count_if(F.col("value") < 0).alias("neg"), F.count("*").alias("k"))
    z = n - F.col("k")
    w = W.partitionBy("var_id")
    ranked = x.join(sums, "var_id").withColumn("r", F.rank().over(w.orderBy("value")) + (F.count("*").over(W.partitionBy("var_id", "value")) - 1) / 2)
    return ranked.withColumn("rank", F.col("r") + F.when(F.col("value") > 0, z).otherwise(0)).withColumn("zero_rank", F.col("neg") + (z + 1) / 2).drop("r", "neg", "k")


def tie_terms(x: DataFrame, n: int) -> DataFrame:
    """var_id, ties: sum of t^3 - t over tied values, zeros included."""
    tied = x.groupBy("var_id", "value").agg(F.count("*").alias("t"))
    some = tied.groupBy("var_id").agg(F.sum(F.pow("t", F.lit(3.0)) - F.col("t")).alias("a"), F.sum("t").alias("k"))
    return some.select("var_id", (F.col("a") + F.pow(n - F.col("k"), F.lit(3.0)) - (n - F.col("k"))).alias("ties"))


def wilcoxon(x: DataFrame, obs: DataFrame, var: DataFrame, groupby: str, reference: str = "rest", tie_correct: bool = False) -> DataFrame:
    """group, var_id, score: the normal score of each group's rank sum against the rest, or against the reference group."""
    labels = obs.filter(F.col(groupby).isNotNull()).select("obs_id", F.col(groupby).cast("string").alias("group"))
    x = x.filter("value <> 0").join(labels, "obs_id")
    sizes = labels.groupBy("group").agg(F.count("*").alias("n"))
    if reference == "rest":
        n_all = labels.count()
        return _rank_scores(x, sizes, var, n_all, tie_correct)
    out = None
    for name in sorted(r[0] for r in sizes.select("group").collect() if r[0] != reference):  # one pass a group, each over two groups' rows
        both = F.col("group").isin(name, reference)
        part = _rank_scores(x.filter(both), sizes.filter(both), var, labels.filter(both).count(), tie_correct).filter(F.col("group") == name)
        out = part if out is None else out.unionByName(part)
    return out


def _rank_scores(x: DataFrame, sizes: DataFrame, var: DataFrame, n_all: int, tie_correct: bool) -> DataFrame:
    ranked = average_ranks(x, n_all)
    stored = ranked.groupBy("group", "var_id").agg(F.sum("rank").alias("r"), F.count("*").alias("k"))
    zero = ranked.groupBy("var_id").agg(F.first("zero_rank").alias("zero_rank"))
    rows = sizes.crossJoin(var.select("var_id")).join(stored, ["group", "var_id"], "left").join(zero, "var_id", "left").fillna(0.0, ["r"]).fillna(0, ["k"])
    total = F.col("r") + (F.col("n") - F.col("k")) * F.coalesce("zero_rank", F.lit((n_all + 1) / 2))
    spread = F.col("n") * (n_all - F.col("n")) * (n_all + 1) / 12.0
    if tie_correct:
        rows = rows.join(tie_terms(x, n_all), "var_id", "left")
        whole = float(n_all) ** 3 - n_all
        spread = spread * F.coalesce(1 - F.col("ties") / whole, F.lit(0.0))
    return rows.select("group", "var_id", "n", ((total - F.col("n") * (n_all + 1) / 2.0) / (F.sqrt(spread) + 1e-12)).alias("score"))


def rank_genes_groups(frame: AnnFrame, groupby: str, method: str = "t-test", reference: str = "rest", tie_correct: bool = False, layer: str | None = None, use_raw: bool | None = None, with_p: bool = True) -> DataFrame:
    """group, rank, var_id, scores, pvals, pvals_adj, logfoldchanges: every column of every group, best first."""
    if method not in METHODS:
        raise ValueError(f"method is one of {', '.join(METHODS)}")
    x, var = frame.expression(layer, use_raw)
    moments = group_moments(x, frame.obs, var, groupby)
    sizes = {r["group"]: r["count"] for r in frame.obs.filter(F.col(groupby).isNotNull()).groupBy(F.col(groupby).cast("string").alias("group")).count().collect()}
    if reference != "rest" and reference not in sizes:
        raise ValueError(f"there is no group {reference}")
    if method != "logreg" and (single := sorted(g for g, n in sizes.items() if n < 2)):
        raise ValueError(f"groups of one row: {', '.join(single)}")
    if method == "logreg":
        return _ordered(logreg_scores(frame, groupby, x, var), ["scores"])
    sums = _against(moments, reference)
    if method == "wilcoxon":
        fold = sums.select("group", "var_id", _fold()(F.col("s") / F.col("n"), F.col("rs") / F.col("rn")).alias("logfc"))
        rows = wilcoxon(x, frame.obs, var, groupby, reference, tie_correct).join(fold, ["group", "var_id"])
        p = 2 * normal_sf(F.abs("score"))
    else:
        rows = welch(sums, method != "t-test")
        p = F.coalesce(F.when(F.col("df").isNotNull(), student_p("score", "df")), F.lit(1.0))
    rows = rows.select("group", "var_id", F.col("score").alias("scores"), F.col("logfc").alias("logfoldchanges"), *([p.alias("pvals")] if with_p else []))
    if with_p:
        rows = benjamini_hochberg(rows, "pvals", "pvals_adj", ["group"], "var_id")
    return _ordered(rows, ["scores", *(["pvals", "pvals_adj"] if with_p else []), "logfoldchanges"])


def _ordered(rows: DataFrame, columns: list[str]) -> DataFrame:
    place = F.row_number().over(W.partitionBy("group").orderBy(F.desc("scores"), "var_id"))
    return rows.select("group", place.alias("rank"), "var_id", *columns)


def filter_markers(markers: DataFrame, max_p_adj: float | None = None, min_logfc: float | None = None) -> DataFrame:
    out = markers
    if max_p_adj is not None:
        out = out.filter(F.col("pvals_adj") < max_p_adj)
    return out if min_logfc is None else out.filter(F.col("logfoldchanges") > min_logfc)


def logreg_scores(frame: AnnFrame, groupby: str, x: DataFrame, var: DataFrame) -> DataFrame:
    """group, var_id, scores: coefficients of a multinomial logistic regression with an L2 penalty of 1 / n."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors, VectorUDT

    names = [r[0] for r in var.select("var_id").orderBy("var_id").collect()]
    at = frame.x.sparkSession.createDataFrame([(v, k) for k, v in enumerate(names)], f"var_id {dict(var.dtypes)['var_id']}, j int")
    labels = frame.obs.filter(F.col(groupby).isNotNull()).select("obs_id", F.col(groupby).cast("string").alias("group"))
    groups = sorted(r[0] for r in labels.select("group").distinct().collect())
    codes = frame.x.sparkSession.createDataFrame([(g, float(k)) for k, g in enumerate(groups)], "group string, label double")
    sparse = F.udf(lambda e: Vectors.sparse(len(names), sorted((r["j"], r["value"]) for r in e)), VectorUDT())
    entries = x.join(at, "var_id").groupBy("obs_id").agg(F.collect_list(F.struct("j", "value")).alias("e"))
    rows = labels.join(codes, "group").join(entries, "obs_id", "left").withColumn("e", F.coalesce("e", F.array().cast("array<struct<j:int,value:double>>"))).select("label", sparse("e").alias("features"))
    fit = LogisticRegression(family="multinomial", standardization=False, regParam=1 / max(1, labels.count()), maxIter=100).fit(rows)
    coefficients = fit.coefficientMatrix.toArray()
    if len(groups) == 2:  # one row of differences serves both
        coefficients = np.stack([coefficients[1] - coefficients[0]] * 2)
    return frame.x.sparkSession.createDataFrame([(g, v, float(coefficients[k, j])) for k, g in enumerate(groups) for j, v in enumerate(names)], f"group string, var_id {dict(var.dtypes)['var_id']}, scores double")


def control_features(frame: AnnFrame, genes: DataFrame, ctrl_size: int = 50, n_bins: int = 25, seed: int = 0, layer: str | None = None) -> DataFrame:
    """var_id of control features: from each bin of like mean that a gene occupies, ctrl_size by md5 order; genes go afterwards."""
    n = frame.n_obs
    sums = frame.var.select("var_id").join(frame.matrix(layer).groupBy("var_id").agg((F.sum("value") / n).alias("m")), "var_id", "left").fillna(0.0, ["m"])
    items = max(int(np.round(frame.n_vars / (n_bins - 1))), 1)
    cells = sums.groupBy("m").agg(F.count("*").alias("k"))
    # least rank of each mean: how many features have a smaller one; distinct means are counted by buckets of their own order
    below = cells.withColumn("rank", F.sum("k").over(W.orderBy("m").rowsBetween(W.unboundedPreceding, 0)) - F.col("k") + 1)
    binned = sums.join(below.select("m", "rank"), "m").select("var_id", F.floor(F.col("rank") / items).alias("bin"))
    used = binned.join(genes.select("var_id"), "var_id", "left_semi").select("bin").distinct()
    pool = binned.join(used, "bin", "left_semi").withColumn("r", F.row_number().over(W.partitionBy("bin").orderBy(keyed_order(F.lit(seed), "var_id"), "var_id")))
    return pool.filter(F.col("r") <= ctrl_size).join(genes.select("var_id"), "var_id", "left_anti").select("var_id")


def score_genes(frame: AnnFrame, genes: DataFrame, score_name: str = "score", ctrl_size: int = 50, n_bins: int = 25, seed: int = 0, layer: str | None = None) -> DataFrame:
    """obs_id, score: mean of the genes less mean of their controls."""
    genes = frame.var.select("var_id").join(genes.select("var_id").distinct(), "var_id", "left_semi")
    if genes.isEmpty():
        raise ValueError("no gene of the set is there")
    parts = genes.withColumn("w", F.lit(1)).unionByName(control_features(frame, genes, ctrl_size, n_bins, seed, layer).withColumn("w", F.lit(-1)))
    sizes = parts.groupBy("w").agg(F.count("*").alias("n"))
    weights = parts.join(sizes, "w").select("var_id", (F.col("w") / F.col("n")).alias("w"))
    got = frame.matrix(layer).join(weights, "var_id").groupBy("obs_id").agg(F.sum(F.col("value") * F.col("w")).alias(score_name))
    return frame.obs.select("obs_id").join(got, "obs_id", "left").fillna(0.0, [score_name])


def score_genes_cell_cycle(frame: AnnFrame, s_genes: DataFrame, g2m_genes: DataFrame, **kw) -> DataFrame:
    """obs_id, S_score, G2M_score, phase."""
    both = score_genes(frame, s_genes, "S_score", **kw).join(score_genes(frame, g2m_genes, "G2M_score", **kw), "obs_id")
    phase = F.when((F.col("S_score") < 0) & (F.col("G2M_score") < 0), "G1").when(F.col("S_score") >= F.col("G2M_score"), "S").otherwise("G2M")
    return both.withColumn("phase", phase)


def embedding_density(frame: AnnFrame, basis: str = "X_umap", groupby: str | None = None, components: tuple[int, int] = (0, 1)) -> DataFrame:
    """obs_id, group, density: Gaussian kernel density (Scott's bandwidth) in the group, scaled to 0..1.

    Points meet within their group by blocks of BLOCK points, so a task holds two blocks whatever the group's size.
    """
    import pyarrow as pa

    a, b = components
    rows = frame.obsm[basis].select("obs_id", F.col("vec")[a].alias("x"), F.col("vec")[b].alias("y"))
    labels = frame.obs.select("obs_id", (F.col(groupby).cast("string") if groupby else F.lit("all")).alias("group"))
    points = rows.join(labels, "obs_id")
    shape = points.groupBy("group").agg(F.count("*").alias("n"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"), F.covar_samp("x", "y").alias("vc"))
    blocks = F.floor(F.pmod(F.xxhash64("obs_id"), F.greatest(F.ceil(F.col("n") / 4096), F.lit(1))))
    placed = points.join(shape, "group").withColumn("block", blocks)
    packed = placed.groupBy("group", "block").agg(F.first("n").alias("n"), F.first("vx").alias("vx"), F.first("vy").alias("vy"), F.first("vc").alias("vc"), F.collect_list(F.struct("obs_id", "x", "y")).alias("p"))
    other = packed.select("group", F.col("p").alias("o"))
    pairs = packed.join(other, "group")

    def kernel(batches):
        for batch in batches:
            for r in batch.to_pylist():
                p = np.array([(e["x"], e["y"]) for e in r["p"]])
                o = np.array([(e["x"], e["y"]) for e in r["o"]])
                n = r["n"]
                cov = np.array([[r["vx"], r["vc"]], [r["vc"], r["vy"]]], float) * n ** (-1 / 3) if n > 1 else np.eye(2)
                inverse = np.linalg.pinv(cov)
                norm = 1 / (n * 2 * np.pi * np.sqrt(max(np.linalg.det(cov), 1e-300)))
                total = np.zeros(len(p))
                for k in range(0, len(p), 512):
                    d = p[k : k + 512, None] - o[None]
                    total[k : k + 512] = np.exp(-0.5 * np.einsum("ijk,kl,ijl->ij", d, inverse, d)).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array([e["obs_id"] for e in r["p"]]), pa.array([r["group"]] * len(p)), pa.array(total * norm)], ["obs_id", "group", "part"])

    dens = pairs.mapInArrow(kernel, "obs_id long, group string, part double").groupBy("obs_id", "group").agg(F.sum("part").alias("d"))
    w = W.partitionBy("group")
    return dens.select("obs_id", "group", ((F.col("d") - F.min("d").over(w)) / (F.max("d").over(w) - F.min("d").over(w) + 1e-12)).alias("density"))
