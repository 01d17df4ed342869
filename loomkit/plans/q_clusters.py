"""Queries for clustering (survey 2.6) and cluster scoring (2.10) on the
``embeddings`` table (64 floats, 10 labels)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomkit.functions.exprs import r6
from loomkit.operators import clustering as C
from loomkit.plans.registry import register
from loomkit.session import load_table


def _emb(spark, sf):
    return load_table(spark, sf, "embeddings")


def _queries(spark, sf):
    """New rows to assign: every embedding scaled by 0.9 (derived, whole table)."""
    e = _emb(spark, sf)
    return e.select("vec_id", F.transform("embedding", lambda v: v * 0.9).alias("embedding"))


_ASSIGN_SQL = """
WITH q AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda v: v * 0.9) AS x FROM embeddings),
r AS (SELECT vec_id AS rid, label, CAST(embedding AS DOUBLE[]) AS y FROM embeddings),
d AS (SELECT q.vec_id, rid, label, list_distance(x, y) AS dist FROM q, r),
b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, rid) AS rn FROM d)"""


@register("assign_nearest", _ASSIGN_SQL + """
SELECT vec_id, rid AS nearest_id, label AS cluster, round(dist, 6) AS distance FROM b WHERE rn = 1""")
def q_assign_nearest(spark, sf):
    out = C.assign_nearest(_queries(spark, sf), "embedding", _emb(spark, sf), "embedding",
                           "label", "vec_id")
    return out.select("vec_id", "nearest_id", "cluster", r6("distance").alias("distance"))


@register("cluster_counts", _ASSIGN_SQL + """
SELECT label AS cluster, count(*) AS n FROM b WHERE rn = 1 GROUP BY label""")
def q_cluster_counts(spark, sf):
    out = C.assign_nearest(_queries(spark, sf), "embedding", _emb(spark, sf), "embedding",
                           "label", "vec_id")
    return C.cluster_counts(out)


@register("cluster_kmeans")
def q_cluster_kmeans(spark, sf):
    e = _emb(spark, sf)
    m = C.cluster_kmeans(C.with_vector(e, "embedding"), k=10, n_init=2, max_iter=20)
    return C.cluster_counts(C.kmeans_labels(m, e, "embedding"))


@register("score_clusters")
def q_score_clusters(spark, sf):
    e = _emb(spark, sf)
    m = C.cluster_kmeans(C.with_vector(e, "embedding"), k=10, n_init=1, max_iter=20)
    return C.kmeans_labels(m, _queries(spark, sf), "embedding").select("vec_id", "cluster")


@register("cluster_minibatch_kmeans")
def q_cluster_minibatch_kmeans(spark, sf):
    _centers, labels = C.cluster_minibatch_kmeans(_emb(spark, sf), "embedding", k=10,
                                                  batch_size=256, max_iter=5)
    return C.cluster_counts(labels)


@register("cluster_gmm")
def q_cluster_gmm(spark, sf):
    e = _emb(spark, sf)
    m = C.cluster_gmm(e, "embedding", k=4, covariance_type="full", max_iter=10)
    return C.cluster_counts(C.gmm_predict(e, "embedding", m)).select(F.col("cluster").alias("prediction"),
                                                                     F.col("n").alias("count"))


@register("cluster_gmm_diag")
def q_cluster_gmm_diag(spark, sf):
    e = _emb(spark, sf)
    m = C.cluster_gmm(e, "embedding", k=4, covariance_type="diag", max_iter=5)
    return C.cluster_counts(C.gmm_predict(e, "embedding", m))


@register("cluster_agglomerative")
def q_cluster_agglomerative(spark, sf):
    e = _emb(spark, sf)
    return C.cluster_counts(C.cluster_agglomerative(e, "embedding", k=5, linkage="ward",
                                                    micro=50))


@register("fit_knn", _ASSIGN_SQL.replace("row_number() OVER (PARTITION BY vec_id ORDER BY dist, rid)",
                                         "row_number() OVER (PARTITION BY vec_id ORDER BY dist, rid)") + """,
v AS (SELECT vec_id, label, count(*) AS votes FROM b WHERE rn <= 5 GROUP BY vec_id, label),
w AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY votes DESC, label) AS r2 FROM v)
SELECT vec_id, label AS prediction FROM w WHERE r2 = 1""")
def q_fit_knn(spark, sf):
    out = C.knn_predict(_queries(spark, sf), "embedding", _emb(spark, sf), "embedding",
                        "label", "vec_id", k=5)
    return out.select("vec_id", "prediction")


def _plane(spark, sf):
    """2-d points: balance and nation of every customer, each third customer
    drawn together into one spot."""
    c = load_table(spark, sf, "customer")
    f = F.when(F.col("c_custkey") % 3 == 0, F.lit(0.001)).otherwise(F.lit(1.0))
    return c.select("c_custkey", F.array(F.col("c_acctbal") * F.lit(0.01) * f, F.col("c_nationkey") * F.lit(1.5) * f)
                    .alias("xy"))


@register("cluster_dbscan", """
WITH RECURSIVE p AS (SELECT c_custkey AS id, c_acctbal * 0.01::DOUBLE * f AS x, c_nationkey * 1.5::DOUBLE * f AS y
  FROM (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN 0.001::DOUBLE ELSE 1.0::DOUBLE END AS f FROM customer)),
e AS (SELECT a.id AS a, b.id AS b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM p a, p b
      WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 4.0),
core AS (SELECT a AS id FROM e GROUP BY a HAVING count(*) >= 5),
ce AS (SELECT a, b FROM e WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
cc AS (SELECT id, id AS label, 0 AS step FROM core
       UNION ALL SELECT ce.a, min(cc.label), cc.step + 1 FROM cc JOIN ce ON ce.b = cc.id WHERE cc.step < 40
       GROUP BY ce.a, cc.step),
top AS (SELECT id, label FROM cc WHERE step = 40),
num AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS cluster FROM (SELECT DISTINCT label FROM top)),
named AS (SELECT id, cluster FROM top JOIN num USING (label)),
edge AS (SELECT e.a AS id, first(named.cluster ORDER BY e.d2, named.cluster) AS cluster
         FROM e JOIN named ON named.id = e.b WHERE e.a NOT IN (SELECT id FROM core) GROUP BY e.a)
SELECT p.id AS c_custkey, CAST(coalesce(named.cluster, edge.cluster, -1) AS BIGINT) AS cluster,
  named.id IS NOT NULL AS core
FROM p LEFT JOIN named ON named.id = p.id LEFT JOIN edge ON edge.id = p.id""")
def q_cluster_dbscan(spark, sf):
    from loomkit.operators.dbscan import cluster_dbscan
    return cluster_dbscan(_plane(spark, sf), "xy", "c_custkey", eps=2.0, min_samples=5)


@register("cluster_agglomerative_single", """
WITH RECURSIVE p AS (SELECT c_custkey AS id, c_acctbal * 0.01::DOUBLE * f AS x, c_nationkey * 1.5::DOUBLE * f AS y
  FROM (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN 0.001::DOUBLE ELSE 1.0::DOUBLE END AS f FROM customer)),
e AS (SELECT a.id AS a, b.id AS b FROM p a, p b
      WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1.0),
cc AS (SELECT id, id AS label, 0 AS step FROM p
       UNION ALL SELECT e.a, min(cc.label), cc.step + 1 FROM cc JOIN e ON e.b = cc.id WHERE cc.step < 120
       GROUP BY e.a, cc.step),
top AS (SELECT id, label FROM cc WHERE step = 120),
num AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS cluster FROM (SELECT DISTINCT label FROM top))
SELECT id AS c_custkey, cluster FROM top JOIN num USING (label)""")
def q_cluster_agglomerative_single(spark, sf):
    out = C.cluster_agglomerative(_plane(spark, sf), "xy", linkage="single", id_col="c_custkey", threshold=1.0)
    return out.select("c_custkey", "cluster")
