"""Queries for evaluation metrics (survey 2.7) on rule-based predictions."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from loomkit.operators import metrics as M
from loomkit.plans import registry
from loomkit.plans.registry import sql_hash
from loomkit.plans.q_splits import LI_KEY_SQL
from loomkit.session import load_table

# operators do not round; the comparison with the oracle does
register = functools.partial(registry.register, digits={"calinski_harabasz": 4})

# binary truth: line status F; rule prediction: discount above 5%
_BIN_SQL = """(SELECT CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS y,
  CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS p, l_discount AS score FROM lineitem)"""


def _binary(spark, sf):
    li = load_table(spark, sf, "lineitem")
    return li.select((F.col("l_linestatus") == "F").cast("int").alias("y"),
                     (F.col("l_discount") > 0.05).cast("int").alias("p"),
                     F.col("l_discount").alias("score"))


_MC_RULE_SQL = ("CASE WHEN l_discount < 0.03 THEN 'A' WHEN l_discount < 0.07 THEN 'N' "
                "ELSE 'R' END")


def _multiclass(spark, sf):
    li = load_table(spark, sf, "lineitem")
    rule = (F.when(F.col("l_discount") < 0.03, "A").when(F.col("l_discount") < 0.07, "N")
             .otherwise("R"))
    return li.select(F.col("l_returnflag").alias("y"), rule.alias("p"), "l_discount", "l_tax",
                     "l_quantity")


@register("metric_accuracy", f"SELECT round(avg(CASE WHEN y = p THEN 1 ELSE 0 END), 6) AS accuracy FROM {_BIN_SQL}")
def q_metric_accuracy(spark, sf):
    return M.accuracy(_binary(spark, sf), "y", "p")


@register("metric_f1_macro", f"""
WITH d AS (SELECT l_returnflag AS y, {_MC_RULE_SQL} AS p FROM lineitem),
c AS (SELECT y AS cls FROM d UNION SELECT p FROM d),
s AS (SELECT cls,
   (SELECT count(*) FROM d WHERE y = cls AND p = cls) AS tp,
   (SELECT count(*) FROM d WHERE y <> cls AND p = cls) AS fp,
   (SELECT count(*) FROM d WHERE y = cls AND p <> cls) AS fn FROM c)
SELECT round(avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0
  ELSE 2.0 * tp / (2 * tp + fp + fn) END), 6) AS f1_macro FROM s""")
def q_metric_f1_macro(spark, sf):
    return M.f1_macro(_multiclass(spark, sf), "y", "p")


_AUC_SQL = """
WITH c AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM {src} GROUP BY score),
r AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING
        AND 1 PRECEDING), 0) AS below FROM c)
SELECT round(sum(pos * (below + neg * 0.5)) / (sum(pos) * sum(neg)), 6) AS auroc FROM r"""


@register("metric_auroc", _AUC_SQL.format(src=_BIN_SQL))
def q_metric_auroc(spark, sf):
    return M.auroc(_binary(spark, sf), "y", "score")


_CONT_SQL = """(SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_extendedprice AS score
  FROM lineitem)"""


@register("metric_auroc_continuous", _AUC_SQL.format(src=_CONT_SQL))
def q_metric_auroc_continuous(spark, sf):
    """AUROC over ~all-distinct scores: exercises the bucketed prefix sum."""
    li = load_table(spark, sf, "lineitem")
    d = li.select((F.col("l_returnflag") == "R").cast("int").alias("y"),
                  F.col("l_extendedprice").alias("score"))
    return M.auroc(d, "y", "score")


def _ovr_long(spark, sf):
    mc = _multiclass(spark, sf)
    arr = F.array(
        F.struct(F.lit("A").alias("cls"), F.col("l_discount").cast("double").alias("score")),
        F.struct(F.lit("N").alias("cls"), F.col("l_tax").cast("double").alias("score")),
        F.struct(F.lit("R").alias("cls"), (F.col("l_quantity") / 50.0).alias("score")))
    return mc.select("y", F.explode(arr).alias("e")).select("y", "e.cls", "e.score")


@register("metric_auroc_ovr", """
WITH l AS (
  SELECT l_returnflag AS y, 'A' AS cls, l_discount AS score FROM lineitem
  UNION ALL SELECT l_returnflag, 'N', l_tax FROM lineitem
  UNION ALL SELECT l_returnflag, 'R', l_quantity / 50.0 FROM lineitem),
c AS (SELECT cls, score, sum(CASE WHEN y = cls THEN 1 ELSE 0 END) AS pos,
        sum(CASE WHEN y = cls THEN 0 ELSE 1 END) AS neg FROM l GROUP BY cls, score),
r AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY cls ORDER BY score ROWS BETWEEN
        UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c),
a AS (SELECT cls, sum(pos * (below + neg * 0.5)) / (sum(pos) * sum(neg)) AS auc FROM r GROUP BY cls)
SELECT round(avg(auc), 6) AS auroc_ovr FROM a""")
def q_metric_auroc_ovr(spark, sf):
    return M.auroc_ovr(_ovr_long(spark, sf), "y", "cls", "score")


@register("metric_log_loss", f"""
SELECT round(avg(-ln(greatest(least(CASE WHEN y = 1 THEN score * 10 ELSE 1 - score * 10 END,
  1 - {M.LOG_LOSS_EPS!r}), {M.LOG_LOSS_EPS!r}))), 6) AS log_loss FROM {_BIN_SQL}""")
def q_metric_log_loss(spark, sf):
    b = _binary(spark, sf)
    p = F.col("score") * 10
    return M.log_loss(b.withColumn("pt", F.when(F.col("y") == 1, p).otherwise(1 - p)), "pt")


_REG_SQL = """
SELECT round(CAST(sum(CAST(abs(y - p) AS DECIMAL(38,10))) AS DOUBLE) / count(*), 6) AS {pre}mae,
  round(sqrt(CAST(sum(CAST((y - p) * (y - p) AS DECIMAL(38,10))) AS DOUBLE) / count(*)), 6) AS {pre}rmse,
  round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS {pre}r2
FROM (SELECT l_extendedprice AS y, l_quantity * 2000.0 AS p FROM lineitem {where})"""


@register("metric_regression", _REG_SQL.format(pre="", where=""))
def q_metric_regression(spark, sf):
    li = load_table(spark, sf, "lineitem")
    d = li.select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 2000.0).alias("p"))
    return M.regression(d, "y", "p")


@register("metric_test_prefix", _REG_SQL.format(
    pre="test_", where=f"WHERE {sql_hash(42, LI_KEY_SQL)} >= {0.7 + 0.15!r}"))
def q_metric_test_prefix(spark, sf):
    from loomkit.plans.q_splits import LI_KEY, lineitem_keyed
    from loomkit.operators.splits import split_three_way
    li = split_three_way(lineitem_keyed(spark, sf), LI_KEY, 0.7, 0.15, 0.15, seed=42)
    d = li.where(F.col("split") == "test").select(
        F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 2000.0).alias("p"))
    return M.regression(d, "y", "p", prefix="test_")


def _emb(spark, sf, noise: bool = False):
    e = load_table(spark, sf, "embeddings")
    cl = F.when(F.col("vec_id") % 13 == 0, F.lit(-1)).otherwise(F.col("label")) if noise \
        else F.col("label")
    return e.select("vec_id", "embedding", cl.alias("cluster"))


@register("metric_n_clusters", """
SELECT count(DISTINCT CASE WHEN vec_id % 13 = 0 THEN -1 ELSE label END) AS n_clusters
FROM embeddings""")
def q_metric_n_clusters(spark, sf):
    return M.n_clusters(_emb(spark, sf, noise=True), "cluster")


_EMB_LONG_SQL = """(SELECT vec_id, label AS cluster, CAST(unnest(embedding) AS DOUBLE) AS x,
  generate_subscripts(embedding, 1) AS dim FROM embeddings)"""


@register("metric_calinski_harabasz", f"""
WITH l AS {_EMB_LONG_SQL},
m AS (SELECT cluster, dim, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM l GROUP BY cluster, dim),
g AS (SELECT dim, sum(s) AS gs, sum(n) AS gn FROM m GROUP BY dim),
p AS (SELECT sum(q - s * s / n) AS within, sum(n * pow(s / n - gs / gn, 2)) AS between
      FROM m JOIN g USING (dim)),
k AS (SELECT count(*) AS n, count(DISTINCT label) AS k FROM embeddings)
SELECT round((between / (k - 1)) / (within / (n - k)), 4) AS calinski_harabasz FROM p, k""")
def q_metric_calinski_harabasz(spark, sf):
    return M.calinski_harabasz(_emb(spark, sf), "vec_id", "embedding", "cluster")


@register("metric_davies_bouldin", f"""
WITH l AS {_EMB_LONG_SQL},
c AS (SELECT cluster, dim, avg(x) AS c FROM l GROUP BY cluster, dim),
d AS (SELECT vec_id, l.cluster, sqrt(sum(pow(x - c, 2))) AS d FROM l JOIN c USING (cluster, dim)
      GROUP BY vec_id, l.cluster),
s AS (SELECT cluster, avg(d) AS s FROM d GROUP BY cluster),
cd AS (SELECT a.cluster AS ci, b.cluster AS cj, sqrt(sum(pow(a.c - b.c, 2))) AS dc
       FROM c a JOIN c b ON a.dim = b.dim AND a.cluster <> b.cluster GROUP BY a.cluster, b.cluster),
r AS (SELECT ci, max((si.s + sj.s) / dc) AS r FROM cd JOIN s si ON si.cluster = ci
      JOIN s sj ON sj.cluster = cj GROUP BY ci)
SELECT round(avg(r), 6) AS davies_bouldin FROM r""")
def q_metric_davies_bouldin(spark, sf):
    return M.davies_bouldin(_emb(spark, sf), "vec_id", "embedding", "cluster")


@register("metric_silhouette_sq", """
WITH p AS (SELECT a.vec_id, a.label AS ca, b.label AS cb,
             pow(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 2) AS d
           FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
m AS (SELECT vec_id, ca, cb, avg(d) AS md FROM p GROUP BY vec_id, ca, cb),
ab AS (SELECT vec_id, max(CASE WHEN ca = cb THEN md END) AS a,
         min(CASE WHEN ca <> cb THEN md END) AS b FROM m GROUP BY vec_id)
SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette_sq
FROM ab""")
def q_metric_silhouette_sq(spark, sf):
    return M.silhouette_squared(_emb(spark, sf), "embedding", "cluster")
