"""Common table expressions that the oracles share."""

BASKETS = """x AS (SELECT l_suppkey AS obs_id, l_partkey AS var_id, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2),
obs AS (SELECT s_suppkey AS obs_id, s_nationkey AS nation, CAST(s_suppkey % 3 AS VARCHAR) AS grp FROM supplier),
var AS (SELECT p_partkey AS var_id, p_brand AS brand, p_type AS type FROM part)"""

DOCUMENTS = """x AS (SELECT obs_id, var_id, CAST(count(*) AS DOUBLE) AS value FROM (SELECT doc_id AS obs_id, unnest(regexp_extract_all(
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]+')) AS var_id FROM documents) GROUP BY 1, 2),
obs AS (SELECT doc_id AS obs_id, lang, source FROM documents),
var AS (SELECT DISTINCT var_id FROM x)"""

EVENTS = """x AS (SELECT user_id AS obs_id, event_type AS var_id, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY 1, 2),
obs AS (SELECT DISTINCT obs_id FROM x), var AS (SELECT DISTINCT var_id FROM x)"""

VECTORS = """vec AS (SELECT vec_id AS obs_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
obs AS (SELECT vec_id AS obs_id, label, 'c' || label AS cluster, 'lib' || (label % 3) AS library FROM embeddings),
pts AS (SELECT obs_id, vec[1] AS px, vec[2] AS py FROM vec)"""

#: log1p of rows scaled to 10 000, from x and obs
LOGNORM = """tot AS (SELECT obs_id, sum(value) AS t FROM x GROUP BY 1),
ln AS (SELECT x.obs_id, x.var_id, ln(1 + value * (10000.0 / t)) AS value FROM x JOIN tot USING (obs_id) WHERE t > 0)"""

#: the 6 nearest of each point by (distance, id)
SPATIAL = VECTORS + """,
knn AS (SELECT src, dst, dist FROM (SELECT a.obs_id AS src, b.obs_id AS dst, sqrt((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py)) AS dist,
  row_number() OVER (PARTITION BY a.obs_id ORDER BY sqrt((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py)), b.obs_id) AS r
  FROM pts a JOIN pts b ON a.obs_id <> b.obs_id) WHERE r <= 6),
sym AS (SELECT src, dst, CAST(1 AS DOUBLE) AS weight FROM (SELECT src, dst FROM knn UNION SELECT dst, src FROM knn))"""
