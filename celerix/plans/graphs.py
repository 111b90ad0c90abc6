"""Queries over neighbour graphs, space and communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from celerix.operators import decomposition, graph, neighbors, spatial, transform
from celerix.plans import sql
from celerix.plans.matrices import _r, rounded
from celerix.plans.registry import query
from celerix.session import cut
from celerix.sources import tables

_D = "list_sum([pow(a.vec[i] - b.vec[i], 2) FOR i IN range(1, len(a.vec) + 1)])"


@query(f"""WITH {sql.VECTORS} SELECT obs_id, CAST(r AS BIGINT) AS rank, nbr_id, {_r("dist", "dist")} FROM (SELECT a.obs_id, b.obs_id AS nbr_id, sqrt({_D}) AS dist, row_number() OVER (PARTITION BY a.obs_id ORDER BY sqrt({_D}), b.obs_id) AS r FROM vec a JOIN vec b ON a.obs_id <> b.obs_id) WHERE r <= 15""")
def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = neighbors.exact_knn(tables.vectors(spark, sf_dir).obsm["X_pca"], 15)
    return rounded(got.withColumn("rank", F.col("rank").cast("long")), "dist")


@query(f"""WITH {sql.VECTORS} SELECT obs_id, nbr_id, library AS part, {_r("dist", "dist")} FROM (SELECT a.obs_id, b.obs_id AS nbr_id, library, sqrt({_D}) AS dist, row_number() OVER (PARTITION BY a.obs_id, library ORDER BY sqrt({_D}), b.obs_id) AS r FROM vec a CROSS JOIN vec b JOIN obs ON obs.obs_id = b.obs_id) WHERE r <= 3 AND obs_id <> nbr_id""")
def knn_in_each_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = tables.vectors(spark, sf_dir)
    got = neighbors.exact_knn(frame.obsm["X_pca"], 3, True, by=neighbors.batch_label(frame, "library")).filter("obs_id <> nbr_id")
    return rounded(got.select("obs_id", "nbr_id", "part", "dist"), "dist")


@query()
def neighbors_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(neighbors.neighbors(tables.vectors(spark, sf_dir)).obsp["connectivities"], "weight")


@query()
def bbknn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(neighbors.bbknn(tables.vectors(spark, sf_dir), "library").obsp["connectivities"], "weight")


@query(f"WITH {sql.SPATIAL} SELECT src, dst, {_r('dist', 'weight')} FROM knn")
def spatial_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.spatial_neighbors_knn(tables.vectors(spark, sf_dir), copy=True).distances, "weight")


_PAIR = "sqrt((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py))"


@query(f"""WITH {sql.VECTORS} SELECT a.obs_id AS src, b.obs_id AS dst, {_r(_PAIR, "weight")} FROM pts a JOIN pts b ON a.obs_id <> b.obs_id WHERE {_PAIR} BETWEEN 0.02 AND 0.1""")
def spatial_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.spatial_neighbors_radius(tables.vectors(spark, sf_dir), (0.02, 0.1), copy=True).distances, "weight")


@query(f"""WITH {sql.VECTORS}, p AS (SELECT obs_id, px, py, library FROM pts JOIN obs USING (obs_id)),
e AS (SELECT src, dst, dist, library FROM (SELECT a.obs_id AS src, b.obs_id AS dst, a.library, {_PAIR} AS dist, row_number() OVER (PARTITION BY a.obs_id ORDER BY {_PAIR}, b.obs_id) AS r FROM p a JOIN p b ON a.library = b.library AND a.obs_id <> b.obs_id) WHERE r <= 5),
q AS (SELECT library, quantile_cont(dist, 0.9) AS q FROM e GROUP BY 1), k AS (SELECT src, dst FROM e JOIN q USING (library) WHERE round(dist, 12) <= round(q, 12)),
d AS (SELECT dst AS id, 1 / sqrt(count(*)) AS d FROM k GROUP BY 1)
SELECT src, dst, {_r("coalesce(s.d, 0) * t.d", "weight")} FROM k LEFT JOIN d s ON s.id = src JOIN d t ON t.id = dst""")
def spatial_library_spectral(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = spatial.spatial_neighbors_knn(tables.vectors(spark, sf_dir), 5, library_key="library", percentile=90, transform="spectral", copy=True)
    return rounded(got.connectivities, "weight")


@query(f"""WITH {sql.SPATIAL}, n AS (SELECT src, sqrt(count(*)) AS n FROM knn GROUP BY 1), p AS (SELECT a.src AS i, b.src AS j, count(*) AS c FROM knn a JOIN knn b ON a.dst = b.dst GROUP BY 1, 2)
SELECT i AS src, j AS dst, {_r("c / (u.n * v.n)", "weight")} FROM p JOIN n u ON u.src = i JOIN n v ON v.src = j""")
def spatial_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.spatial_neighbors_knn(tables.vectors(spark, sf_dir), transform="cosine", copy=True).connectivities, "weight")


@query(f"""WITH {sql.SPATIAL}, m AS (SELECT median(dist) AS m FROM knn), b AS (SELECT src, dst FROM knn CROSS JOIN m WHERE dist < 1.3 * m),
w AS (SELECT DISTINCT a.src, c.dst FROM b a JOIN b c ON a.dst = c.src WHERE a.src <> c.dst)
SELECT src, dst, CAST(1 AS DOUBLE) AS weight FROM b UNION ALL SELECT src, dst, CAST(2 AS DOUBLE) FROM w WHERE (src, dst) NOT IN (SELECT (src, dst) FROM b)""")
def spatial_grid_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.spatial_neighbors_grid(tables.vectors(spark, sf_dir), n_rings=2, copy=True).distances


@query()
def spatial_delaunay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.spatial_neighbors_delaunay(tables.vectors(spark, sf_dir), copy=True).distances, "weight")


def _spatial_frame(spark: SparkSession, sf_dir: str):
    return spatial.spatial_neighbors_knn(tables.vectors(spark, sf_dir))


_AUTOCORR = f"""{sql.SPATIAL}, e AS (SELECT src, dst, 1.0 / 6 AS weight FROM knn), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM obs),
xv AS (SELECT obs_id, unnest(range(len(vec))) AS var_id, unnest(vec) AS value FROM vec), mu AS (SELECT var_id, avg(value) AS mu FROM xv GROUP BY 1), z AS (SELECT obs_id, var_id, value - mu AS z FROM xv JOIN mu USING (var_id)),
zz AS (SELECT var_id, sum(z * z) AS zz FROM z GROUP BY 1), s0 AS (SELECT sum(weight) AS s0 FROM e),
s1 AS (SELECT sum(pow(coalesce(a.weight, 0) + coalesce(b.weight, 0), 2)) / 2 AS s1 FROM e a FULL JOIN e b ON a.src = b.dst AND a.dst = b.src),
s2 AS (SELECT sum(w * w) AS s2 FROM (SELECT i, sum(weight) AS w FROM (SELECT src AS i, weight FROM e UNION ALL SELECT dst, weight FROM e) GROUP BY 1))"""


@query(f"""WITH {_AUTOCORR}, c AS (SELECT u.var_id, sum(weight * u.z * v.z) AS c FROM e JOIN z u ON u.obs_id = src JOIN z v ON v.obs_id = dst AND v.var_id = u.var_id GROUP BY 1)
SELECT CAST(var_id AS INTEGER) AS var_id, {_r("n / s0 * c / zz", "I")}, {_r("(n * n * s1 - n * s2 + 3 * s0 * s0) / ((n - 1) * (n + 1) * s0 * s0) - 1 / ((n - 1) * (n - 1))", "var_norm", 9)} FROM c JOIN zz USING (var_id) CROSS JOIN n CROSS JOIN s0 CROSS JOIN s1 CROSS JOIN s2""")
def moran(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = spatial.spatial_autocorr(_spatial_frame(spark, sf_dir), "moran", with_p=False)
    return rounded(rounded(got, "I"), "var_norm", places=9)


@query(f"""WITH {_AUTOCORR}, c AS (SELECT u.var_id, sum(weight * (u.z - v.z) * (u.z - v.z)) AS c FROM e JOIN z u ON u.obs_id = src JOIN z v ON v.obs_id = dst AND v.var_id = u.var_id GROUP BY 1)
SELECT CAST(var_id AS INTEGER) AS var_id, {_r("(n - 1) / (2 * s0) * c / zz", "C")}, {_r("((2 * s1 + s2) * (n - 1) - 4 * s0 * s0) / (2 * (n + 1) * s0 * s0)", "var_norm", 9)} FROM c JOIN zz USING (var_id) CROSS JOIN n CROSS JOIN s0 CROSS JOIN s1 CROSS JOIN s2""")
def geary(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = spatial.spatial_autocorr(_spatial_frame(spark, sf_dir), "geary", with_p=False)
    return rounded(rounded(got, "C"), "var_norm", places=9)


_PERM = """pos AS (SELECT obs_id AS new_id, row_number() OVER (ORDER BY obs_id) AS p FROM obs),
drawn AS (SELECT k AS perm_id, obs_id AS id, row_number() OVER (PARTITION BY k ORDER BY md5(concat_ws('|', '0', CAST(k AS VARCHAR), CAST(obs_id AS VARCHAR))), obs_id) AS p FROM obs CROSS JOIN range(20) t(k)),
perm AS (SELECT perm_id, id, new_id FROM drawn JOIN pos USING (p))"""


@query(f"""WITH {_AUTOCORR}, {_PERM}, c AS (SELECT u.var_id, sum(weight * u.z * v.z) AS c FROM e JOIN z u ON u.obs_id = src JOIN z v ON v.obs_id = dst AND v.var_id = u.var_id GROUP BY 1),
obsd AS (SELECT var_id, n / s0 * c / zz AS I FROM c JOIN zz USING (var_id) CROSS JOIN n CROSS JOIN s0),
pc AS (SELECT u.var_id, perm_id, sum(weight * u.z * v.z) AS c FROM e JOIN perm ON perm.id = src JOIN z u ON u.obs_id = new_id JOIN z v ON v.obs_id = dst AND v.var_id = u.var_id GROUP BY 1, 2),
sims AS (SELECT var_id, n / s0 * c / zz AS sim FROM pc JOIN zz USING (var_id) CROSS JOIN n CROSS JOIN s0)
SELECT CAST(var_id AS INTEGER) AS var_id, {_r("any_value(I)", "I")}, {_r("(least(count(*) FILTER (sim >= I), 20 - count(*) FILTER (sim >= I)) + 1) / 21.0", "pval_sim")}, {_r("var_pop(sim)", "var_sim", 9)} FROM sims JOIN obsd USING (var_id) GROUP BY 1""")
def moran_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = spatial.spatial_autocorr(_spatial_frame(spark, sf_dir), "moran", n_perms=20, with_p=False, corr_method=None)
    return rounded(rounded(got.select("var_id", "I", "pval_sim", "var_sim"), "I", "pval_sim"), "var_sim", places=9)


@query()
def moran_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = spatial.spatial_autocorr(_spatial_frame(spark, sf_dir), "moran", n_perms=20)
    return rounded(got, *[c for c in got.columns if c != "var_id"])


@query(f"""WITH {sql.SPATIAL} SELECT src, dst, {_r("1.0 / 6", "weight")} FROM knn""")
def row_normalized_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(transform.row_normalize(_spatial_frame(spark, sf_dir).obsp["spatial_connectivities"]), "weight")


_LIMITS = "[0.05, 0.1, 0.2, 0.3, 0.5]"


@query(f"""WITH {sql.VECTORS}, p AS (SELECT obs_id, px, py, cluster FROM pts JOIN obs USING (obs_id)), t AS (SELECT unnest(range(5)) AS bin, unnest({_LIMITS}) AS threshold),
d AS (SELECT a.cluster AS cc, b.cluster AS ci, {_PAIR} AS dist FROM p a JOIN p b ON a.obs_id <> b.obs_id WHERE {_PAIR} <= 0.5), k AS (SELECT DISTINCT cluster FROM obs),
g AS (SELECT u.cluster AS cc, v.cluster AS ci, bin, threshold FROM k u CROSS JOIN k v CROSS JOIN t), c AS (SELECT g.cc, g.ci, g.bin, g.threshold, count(dist) AS n FROM g LEFT JOIN d ON d.cc = g.cc AND d.ci = g.ci AND dist <= threshold GROUP BY 1, 2, 3, 4),
o AS (SELECT *, sum(n) OVER (PARTITION BY cc, bin) AS given, sum(n) OVER (PARTITION BY ci, bin) AS alone, sum(n) OVER (PARTITION BY bin) AS whole FROM c)
SELECT ci AS cluster_i, cc AS cluster_c, CAST(bin AS INTEGER) AS bin, CAST(threshold AS DOUBLE) AS threshold, {_r("CASE WHEN given > 0 AND alone > 0 THEN (n / given) / (alone / whole) ELSE 0 END", "occ")} FROM o WHERE bin > 0""")
def co_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.co_occurrence(tables.vectors(spark, sf_dir), "cluster", [0.05, 0.1, 0.2, 0.3, 0.5]), "occ")


@query(f"""WITH {sql.VECTORS}, {_PERM}, xv AS (SELECT obs_id, unnest(range(2, 6)) AS var_id, unnest(vec[3:6]) AS value FROM vec), pr(source, target) AS (VALUES (2, 3), (4, 5), (3, 2)),
lab AS (SELECT -1 AS perm_id, obs_id, cluster FROM obs UNION ALL SELECT perm_id, id, cluster FROM perm JOIN obs ON obs.obs_id = new_id),
m AS (SELECT perm_id, cluster, var_id, avg(value) AS m FROM lab JOIN xv USING (obs_id) GROUP BY 1, 2, 3),
s AS (SELECT l.perm_id, source, target, l.cluster AS cluster_1, r.cluster AS cluster_2, (l.m + r.m) / 2 AS mean FROM pr JOIN m l ON l.var_id = source JOIN m r ON r.var_id = target AND r.perm_id = l.perm_id)
SELECT CAST(a.source AS INTEGER) AS source, CAST(a.target AS INTEGER) AS target, a.cluster_1, a.cluster_2, {_r("any_value(a.mean)", "mean")}, {_r("(count(*) FILTER (b.mean >= a.mean - 1e-12) + 1) / 21.0", "pvalue")}
FROM s a JOIN s b ON a.source = b.source AND a.target = b.target AND a.cluster_1 = b.cluster_1 AND a.cluster_2 = b.cluster_2 WHERE a.perm_id = -1 AND b.perm_id >= 0 GROUP BY 1, 2, 3, 4""")
def ligrec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.ligrec(tables.vectors(spark, sf_dir), "cluster", [(2, 3), (4, 5), (3, 2), (2, 999)], n_perms=20), "mean", "pvalue")


@query(f"""WITH {sql.SPATIAL}, c AS (SELECT src AS obs_id, cluster AS label, CAST(count(*) AS DOUBLE) AS w FROM knn JOIN obs ON obs.obs_id = dst GROUP BY 1, 2)
SELECT obs_id, label, {_r("w / (sum(w) OVER (PARTITION BY obs_id) + 1e-12)", "share")} FROM c""")
def niche_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.niche_composition(_spatial_frame(spark, sf_dir), "cluster"), "share")


@query()
def calculate_niche(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.calculate_niche(_spatial_frame(spark, sf_dir), "cluster", 4).obs.select("obs_id", "niche")


def symmetric(spark: SparkSession, sf_dir: str) -> tuple:
    """The undirected 6-nearest graph and the labels as communities."""
    frame = tables.vectors(spark, sf_dir)
    e = spatial.spatial_neighbors_knn(frame, copy=True).distances
    return frame, spatial.undirected(e), frame.obs.select(F.col("obs_id").alias("id"), F.col("label").cast("long").alias("comm"))


@query(f"WITH {sql.SPATIAL} SELECT src AS id, sum(weight) AS k FROM sym GROUP BY 1")
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(symmetric(spark, sf_dir)[1])


@query(f"""WITH {sql.SPATIAL}, m AS (SELECT sum(weight) AS m FROM sym), c AS (SELECT a.label AS comm, sum(CASE WHEN a.label = b.label THEN weight ELSE 0 END) AS inside, sum(weight) AS tot FROM sym JOIN obs a ON a.obs_id = src JOIN obs b ON b.obs_id = dst GROUP BY 1)
SELECT CAST(comm AS BIGINT) AS comm, inside, tot, {_r("inside / m - (tot / m) * (tot / m)", "q")} FROM c CROSS JOIN m""")
def modularity_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges, comm = symmetric(spark, sf_dir)
    m = F.broadcast(edges.agg(F.sum("weight").alias("m")))  # one row
    return rounded(graph.modularity_terms(edges, comm).crossJoin(m).select("comm", "inside", "tot", (F.col("inside") / F.col("m") - (F.col("tot") / F.col("m")) * (F.col("tot") / F.col("m"))).alias("q")), "q")


@query(f"WITH {sql.SPATIAL} SELECT CAST(a.label AS BIGINT) AS src, CAST(b.label AS BIGINT) AS dst, sum(weight) AS weight FROM sym JOIN obs a ON a.obs_id = src JOIN obs b ON b.obs_id = dst GROUP BY 1, 2")
def contracted_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges, comm = symmetric(spark, sf_dir)
    return graph.contract(edges, comm)


@query(f"WITH {sql.SPATIAL} SELECT src AS id, CAST(label AS BIGINT) AS comm, sum(weight) AS w FROM sym JOIN obs ON obs_id = dst WHERE src <> dst GROUP BY 1, 2")
def neighbour_community_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges, comm = symmetric(spark, sf_dir)
    return graph.neighbour_weights(edges, comm)


@query(f"""WITH {sql.SPATIAL}, m AS (SELECT sum(weight) AS m FROM sym), k AS (SELECT src AS id, sum(weight) AS k FROM sym GROUP BY 1), o AS (SELECT obs_id AS id, CAST(label AS BIGINT) AS own, k FROM obs JOIN k ON k.id = obs_id),
t AS (SELECT own AS comm, sum(k) AS tot FROM o GROUP BY 1), w AS (SELECT src AS id, CAST(label AS BIGINT) AS comm, sum(weight) AS w FROM sym JOIN obs ON obs_id = dst GROUP BY 1, 2),
e AS (SELECT id, comm, sum(w) AS w FROM (SELECT id, comm, w FROM w UNION ALL SELECT id, own, 0.0 FROM o) GROUP BY 1, 2),
g AS (SELECT id, own, comm, w - (tot - CASE WHEN comm = own THEN k ELSE 0 END) * k / m AS gain FROM e JOIN o USING (id) JOIN t USING (comm) CROSS JOIN m)
SELECT id, own, {_r("max(gain)", "gain")}, {_r("max(gain) FILTER (comm = own)", "stay")} FROM g GROUP BY 1, 2""")
def local_moving_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges, comm = symmetric(spark, sf_dir)
    edges = cut(edges)
    got = graph.move_gains(edges, comm, graph.degrees(edges), graph.total_weight(edges), 1.0)
    return rounded(got.select("id", "own", "gain", "stay"), "gain", "stay")


@query(f"""WITH {sql.SPATIAL}, e AS (SELECT src, dst, weight FROM sym), d AS (SELECT src, sum(weight) AS d FROM e GROUP BY 1), w AS (SELECT e.src, e.dst, weight / a.d / b.d AS weight FROM e JOIN d a ON a.src = e.src JOIN d b ON b.src = e.dst),
z AS (SELECT src, sqrt(sum(weight)) AS z FROM w GROUP BY 1) SELECT w.src, w.dst, {_r("weight / a.z / b.z", "weight")} FROM w JOIN z a ON a.src = w.src JOIN z b ON b.src = w.dst""")
def diffusion_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(decomposition.diffusion_operator(symmetric(spark, sf_dir)[1]), "weight")


@query(f"""WITH {sql.SPATIAL}, r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist DESC, dst) AS r FROM knn), t AS (SELECT src, dist AS t FROM r WHERE r = 3), a AS (SELECT knn.src, dst, dist FROM knn LEFT JOIN t USING (src) WHERE t IS NULL OR dist >= t),
u AS (SELECT dst, dist AS t FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY dist DESC, src) AS r FROM a) WHERE r = 3) SELECT src, dst, {_r("dist", "weight")} FROM a LEFT JOIN u USING (dst) WHERE t IS NULL OR dist >= t""")
def trimmed_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(neighbors.trim(cut(spatial.spatial_neighbors_knn(tables.vectors(spark, sf_dir), copy=True).distances), 3), "weight")


@query(f"""WITH {sql.SPATIAL}, e AS (SELECT src, dst, exp(-dist) AS w FROM knn) SELECT coalesce(a.src, b.dst) AS src, coalesce(a.dst, b.src) AS dst, {_r("coalesce(a.w, 0) + coalesce(b.w, 0) - coalesce(a.w, 0) * coalesce(b.w, 0)", "weight")} FROM e a FULL JOIN e b ON a.src = b.dst AND a.dst = b.src""")
def fuzzy_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spatial.spatial_neighbors_knn(tables.vectors(spark, sf_dir), copy=True).distances
    return rounded(neighbors.fuzzy_union(e.withColumn("weight", F.exp(-F.col("weight")))), "weight")
