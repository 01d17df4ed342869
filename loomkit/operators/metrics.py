"""Evaluation metrics as aggregations over (label, prediction[, score]).

Every metric is a DataFrame: no value is pulled to the driver to be combined.
Ranks (AUROC) are built from per-distinct-score counts and an exact bucketed
prefix sum, so no global window runs in one task.
"""

from __future__ import annotations

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomkit.functions.exprs import with_scalars

from loomkit.functions.prefix import prefix_sums
from loomkit.session import cut_lineage

LOG_LOSS_EPS = 2.220446049250313e-16  # fixed value: float64 machine epsilon

# Direction of each metric (True = higher is better).
HIGHER_IS_BETTER = {
    "r2": True, "accuracy": True, "auroc": True, "f1_macro": True, "precision_at_k": True,
    "recall_at_k": True, "ndcg_at_k": True, "silhouette": True, "calinski_harabasz": True,
    "mae": False, "rmse": False, "smape": False, "davies_bouldin": False, "log_loss": False,
}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- classification

def accuracy(df: DataFrame, label: str, pred: str) -> DataFrame:
    return df.agg(F.avg((_c(label) == _c(pred)).cast("int")).alias("accuracy"))


def _class_counts(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Per class: tp, fp, fn (classes = truth union prediction)."""
    pairs = df.groupBy(_c(label).cast("string").alias("y"),
                       _c(pred).cast("string").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    same = F.col("y") == F.col("p")
    contrib = F.array(
        F.struct(F.col("y").alias("cls"), F.when(same, F.col("n")).otherwise(0).alias("tp"),
                 F.lit(0).cast("long").alias("fp"),
                 F.when(same, 0).otherwise(F.col("n")).alias("fn")),
        F.struct(F.col("p").alias("cls"), F.lit(0).cast("long").alias("tp"),
                 F.when(same, 0).otherwise(F.col("n")).alias("fp"),
                 F.lit(0).cast("long").alias("fn")))
    return (pairs.select(F.explode(contrib).alias("c")).select("c.*")
                 .groupBy("cls").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"),
                                     F.sum("fn").alias("fn")))


def f1_per_class(df: DataFrame, label: str, pred: str) -> DataFrame:
    cc = _class_counts(df, label, pred)
    den = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return cc.withColumn("f1", F.when(den == 0, 0.0).otherwise(2.0 * F.col("tp") / den))


def f1_macro(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Unweighted mean F1 over labels in truth or prediction; 0/0 -> 0."""
    return f1_per_class(df, label, pred).agg(F.avg("f1").alias("f1_macro"))


def _auc_from_counts(counts: DataFrame, group_cols: list[str]) -> DataFrame:
    """``counts``: (group..., score, pos, neg) with one row per distinct score."""
    pre = prefix_sums(counts, "score", ["neg"], prefix="below_", group_cols=group_cols)
    return (pre.groupBy(*group_cols)
               .agg((F.sum(F.col("pos").cast("double") * (F.col("below_neg").cast("double") + F.col("neg") * 0.5))
                     / (F.sum("pos").cast("double") * F.sum("neg").cast("double"))).alias("auc")))


def auroc(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    """Binary AUROC: Mann-Whitney statistic with ties counted one half."""
    pos = (_c(label) == F.lit(positive)).cast("long")
    counts = df.groupBy(_c(score).cast("double").alias("score")).agg(
        F.sum(pos).alias("pos"), F.sum(1 - pos).alias("neg"))
    return _auc_from_counts(counts, []).select(F.col("auc").alias("auroc"))


def auroc_ovr(df_long: DataFrame, label: str, cls: str, score: str) -> DataFrame:
    """Macro one-vs-rest AUROC from a long frame (row, label, class, score)."""
    pos = (_c(label).cast("string") == _c(cls).cast("string")).cast("long")
    counts = df_long.groupBy(_c(cls).alias("cls"), _c(score).cast("double").alias("score")) \
                    .agg(F.sum(pos).alias("pos"), F.sum(1 - pos).alias("neg"))
    per = _auc_from_counts(counts, ["cls"])
    return per.agg(F.avg("auc").alias("auroc_ovr"))


def log_loss(df: DataFrame, prob_true: str, eps: float = LOG_LOSS_EPS) -> DataFrame:
    """Mean negative log of the probability given to the true class, clipped."""
    p = F.greatest(F.least(_c(prob_true), F.lit(1.0 - eps)), F.lit(eps))
    return df.agg(F.avg(-F.log(p)).alias("log_loss"))


# ---------------------------------------------------------------- regression

def regression(df: DataFrame, label: str, pred: str, prefix: str = "") -> DataFrame:
    """mae, rmse, r2 in one pass over doubles."""
    err = _c(label).cast("double") - _c(pred).cast("double")
    y = _c(label).cast("double")
    agg = df.agg(F.avg(F.abs(err)).alias("mae"),
                 F.avg(err * err).alias("mse"),
                 F.sum(err * err).alias("sse"),
                 F.var_pop(y).alias("vy"), F.count(y).alias("n"))
    r2 = F.when(F.col("vy") == 0, F.lit(None).cast("double")).otherwise(
        1 - F.col("sse") / (F.col("vy") * F.col("n")))
    return agg.select(F.col("mae").alias(f"{prefix}mae"), F.sqrt("mse").alias(f"{prefix}rmse"),
                      r2.alias(f"{prefix}r2"))


def forecast(df: DataFrame, series_cols: list[str], actual: str, pred: str) -> DataFrame:
    """Per series: mae, rmse, sMAPE = 100 mean(|a-f| / ((|a|+|f|)/2)); zero den -> 1e-12."""
    a, f = _c(actual).cast("double"), _c(pred).cast("double")
    den = (F.abs(a) + F.abs(f)) / 2.0
    den = F.when(den == 0, F.lit(1e-12)).otherwise(den)
    return df.groupBy(*series_cols).agg(
        F.avg(F.abs(a - f)).alias("mae"),
        F.sqrt(F.avg((a - f) * (a - f))).alias("rmse"),
        (100.0 * F.avg(F.abs(a - f) / den)).alias("smape"))


def ratings(df: DataFrame, label: str, pred: str) -> DataFrame:
    err = _c(label).cast("double") - _c(pred).cast("double")
    return df.agg(F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"))


def ranking_at_k(recs: DataFrame, relevant: DataFrame, user: str, item: str, rank: str,
                 k: int) -> DataFrame:
    """precision@k (/k), recall@k (/relevant), ndcg@k, averaged over users with
    held-out items.  ``rank`` is 0-based; ``recs`` may hold more than k rows."""
    top = recs.where(F.col(rank) < k).select(user, item, rank)
    rel = relevant.select(user, item).distinct()
    n_rel = rel.groupBy(user).agg(F.count(F.lit(1)).alias("n_rel"))
    hits = top.join(rel.withColumn("_hit", F.lit(1)), [user, item], "inner") \
              .groupBy(user).agg(F.count(F.lit(1)).alias("hits"),
                                 F.sum(1.0 / F.log2(F.col(rank) + 2.0)).alias("dcg"))
    per = n_rel.join(hits, user, "left").fillna({"hits": 0, "dcg": 0.0})
    # ideal DCG of min(k, n_rel) hits: sum_{i<m} 1/log2(i+2), a closed array sum
    m = F.least(F.lit(k), F.col("n_rel"))
    idcg = F.aggregate(F.sequence(F.lit(0), m - 1), F.lit(0.0),
                       lambda acc, i: acc + 1.0 / F.log2(i.cast("double") + 2.0))
    per = per.withColumn("idcg", idcg)
    return per.agg(
        F.avg(F.col("hits") / F.lit(float(k))).alias("precision_at_k"),
        F.avg(F.col("hits") / F.col("n_rel")).alias("recall_at_k"),
        F.avg(F.col("dcg") / F.col("idcg")).alias("ndcg_at_k"),
        F.count(F.lit(1)).alias("n_users"))


# ---------------------------------------------------------------- clustering

def n_clusters(df: DataFrame, cluster: str) -> DataFrame:
    """Distinct cluster labels, noise (-1) included."""
    return df.agg(F.count_distinct(_c(cluster)).alias("n_clusters"))


def cluster_moments(df: DataFrame, vec: str, cluster: str) -> DataFrame:
    """Per cluster: size, centroid and total squared deviation from it, in one
    aggregate over whole vectors (partial sums per task)."""
    v = array_to_vector(F.col(vec).cast("array<double>"))
    g = df.where(F.col(vec).isNotNull()).groupBy(F.col(cluster).alias("cluster")).agg(
        F.count(F.lit(1)).alias("n"), Summarizer.mean(v).alias("c"), Summarizer.variance(v).alias("var"))
    total = F.aggregate(vector_to_array("var"), F.lit(0.0), lambda a, x: a + x)
    return g.select("cluster", "n", vector_to_array("c").alias("c"),
                    F.when(F.col("n") > 1, total * (F.col("n") - 1)).otherwise(0.0).alias("within"))


def _squared_distance(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, d: a + d)


def calinski_harabasz(df: DataFrame, id_col: str, vec: str, cluster: str) -> DataFrame:
    """Between / within dispersion ratio from one scan (no pairs, no row per
    dimension); what follows the aggregate has one row per cluster."""
    mo = cluster_moments(df, vec, cluster)
    whole = mo.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("within").alias("within"),
                   Summarizer.mean(array_to_vector("c"), F.col("n").cast("double")).alias("g"),
                   F.collect_list(F.struct("n", "c")).alias("parts"))
    between = F.aggregate(F.transform("parts", lambda p: p["n"] * _squared_distance(p["c"], vector_to_array("g"))),
                          F.lit(0.0), lambda a, x: a + x)
    ch = (between / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))
    return whole.select(ch.alias("calinski_harabasz"))


MAX_BROADCAST_CLUSTERS = 10_000  # centroid tables up to so many rows are broadcast, longer ones joined


def davies_bouldin(df: DataFrame, id_col: str, vec: str, cluster: str) -> DataFrame:
    """Mean over clusters of the worst (s_i + s_j) / d(c_i, c_j).

    Two scans: centroids, then the distance of every row to its own, folded
    inside the row.  The pairs are clusters x clusters."""
    cen = cut_lineage(cluster_moments(df, vec, cluster).select("cluster", "c"))
    side = F.broadcast(cen) if cen.count() <= MAX_BROADCAST_CLUSTERS else cen
    own = df.select(F.col(cluster).alias("cluster"), F.col(vec).cast("array<double>").alias("x")) \
        .where("x is not null").join(side, "cluster")
    spread = own.groupBy("cluster").agg(F.avg(F.sqrt(_squared_distance(F.col("x"), F.col("c")))).alias("s"))
    one = cut_lineage(cen.join(spread, "cluster"))
    dims = one.select("cluster", "s", F.posexplode("c").alias("dim", "x"))  # clusters x dimensions rows
    a, b = dims.alias("a"), dims.alias("b")
    r = a.join(b, (F.col("a.dim") == F.col("b.dim")) & (F.col("a.cluster") != F.col("b.cluster"))) \
        .groupBy(F.col("a.cluster").alias("ci"), F.col("b.cluster").alias("cj")) \
        .agg(F.first(F.col("a.s") + F.col("b.s")).alias("s"),
             F.sqrt(F.sum(F.pow(F.col("a.x") - F.col("b.x"), 2))).alias("d"))
    return r.groupBy("ci").agg(F.max(F.col("s") / F.col("d")).alias("r")).agg(F.avg("r").alias("davies_bouldin"))


def silhouette_squared(df: DataFrame, vec: str, cluster: str) -> DataFrame:
    """Silhouette with squared euclidean distance (exact, O(n k), no pairs).

    Uses ``pyspark.ml``'s ``ClusteringEvaluator``, which reduces each cluster
    to sufficient statistics.  The euclidean (non-squared) silhouette needs
    every pair of rows and is not offered.
    """
    vdf = df.select(array_to_vector(F.col(vec).cast("array<double>")).alias("features"),
                    F.col(cluster).cast("double").alias("prediction"))
    ev = ClusteringEvaluator(featuresCol="features", predictionCol="prediction",
                             metricName="silhouette", distanceMeasure="squaredEuclidean")
    value = ev.evaluate(vdf)
    spark = df.sparkSession
    return spark.range(1).select(F.lit(value).alias("silhouette_sq"))
