"""Clustering: k-means (full and mini-batch), Gaussian mixtures, a two-phase
agglomerative clustering, nearest-reference assignment and cluster counts.

Distances are computed per row against a bounded set of centres; searches
against references of any size are in ``neighbours``, DBSCAN is in ``dbscan``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomkit.operators.neighbours import assign_nearest, knn_predict
from loomkit.session import cut_lineage, ship_package



def with_vector(df: DataFrame, array_col: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(array_col).cast("array<double>")))


def cluster_kmeans(df: DataFrame, k: int = 8, init: str = "k-means++", n_init: int = 10,
                   max_iter: int = 300, seed: int = 42, features: str = "features"):
    """Best of ``n_init`` seeded fits by training cost (the features are
    persisted once for all fits)."""
    from pyspark import StorageLevel

    mode = "k-means||" if init == "k-means++" else "random"
    data = df.select(features).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        best = None
        for i in range(max(1, n_init)):
            m = KMeans(k=k, initMode=mode, maxIter=max_iter, seed=seed + i,
                       featuresCol=features).fit(data)
            cost = m.summary.trainingCost
            if best is None or cost < best[0]:
                best = (cost, m)
    finally:
        data.unpersist()
    return best[1]


def _assign_expr(vec: Column, centers: np.ndarray) -> Column:
    """Index of the nearest centre (squared euclidean) as an expression over a
    literal centre matrix (k x d, bounded by k)."""
    best = None
    best_d = None
    for j, c in enumerate(centers):
        d = F.aggregate(F.zip_with(vec, F.array(*[F.lit(float(v)) for v in c]),
                                   lambda a, b: (a - b) * (a - b)), F.lit(0.0),
                        lambda s, v: s + v)
        if best is None:
            best, best_d = F.lit(j), d
        else:
            best = F.when(d < best_d, F.lit(j)).otherwise(best)
            best_d = F.least(d, best_d)
    return best


def _hash_seeds(df: DataFrame, vec, k: int, seed: int) -> np.ndarray:
    """``k`` distinct vectors in the order of a seeded hash over all rows (a
    per-task top-k, then a merge): no prefix of the table."""
    rows = df.select(vec.alias("x")).where("x is not null").distinct() \
        .orderBy(F.xxhash64(F.lit(seed), "x"), "x").limit(k).collect()
    return np.array([r[0] for r in rows], dtype=float)


def cluster_minibatch_kmeans(df: DataFrame, array_col: str, k: int = 8, batch_size: int = 1024,
                             max_iter: int = 100, seed: int = 42,
                             checkpoint_every: int = 10) -> tuple[np.ndarray, DataFrame]:
    """Mini-batch k-means: each iteration samples ~``batch_size`` rows, assigns
    them to the nearest centre and moves every centre towards its batch mean
    with rate ``n_batch / n_seen``.  Only the k centres visit the driver."""
    n = df.count()
    frac = min(1.0, batch_size / max(n, 1))
    centers = _hash_seeds(df, F.col(array_col), k, seed)
    if len(centers) < k:
        raise ValueError("fewer rows than clusters")
    seen = np.zeros(k)
    vec = F.col(array_col).cast("array<double>")
    for it in range(max_iter):
        batch = df.select(vec.alias("x")).sample(False, frac, seed + it + 1)
        assigned = batch.withColumn("c", _assign_expr(F.col("x"), centers))
        stats = assigned.groupBy("c").agg(
            Summarizer.mean(array_to_vector("x")).alias("m"), F.count(F.lit(1)).alias("n")) \
            .collect()
        moved = 0.0
        for r in stats:
            j, nb = int(r["c"]), int(r["n"])
            seen[j] += nb
            step = nb / seen[j]
            new = centers[j] + step * (np.asarray(r["m"].toArray()) - centers[j])
            moved = max(moved, float(np.abs(new - centers[j]).max()))
            centers[j] = new
        if moved < 1e-6:
            break
    labels = df.withColumn("cluster", _assign_expr(vec, centers))
    return centers, labels


def _log_densities(x: np.ndarray, model: dict) -> np.ndarray:
    """Weighted log densities (rows x components) of a full-covariance model."""
    out = np.empty((len(x), len(model["weights"])))
    for j, (w, m, c) in enumerate(zip(model["weights"], model["means"], model["covariances"])):
        low = np.linalg.cholesky(c)
        z = np.linalg.solve(low, (x - m).T)
        out[:, j] = (np.log(max(w, 1e-300)) - 0.5 * (z * z).sum(axis=0) - np.log(np.diag(low)).sum()
                     - 0.5 * len(m) * np.log(2 * np.pi))
    return out


def _gmm_sums(model: dict):
    """Per task: log likelihood (place 0) and, per component, weight, weighted
    sums and products of the distances from its mean."""
    def run(batches):
        k, d = model["means"].shape
        total, ll = np.zeros((k, 1 + d + d * d)), 0.0
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.array(pdf["x"].tolist(), dtype=float)
            lp = _log_densities(x, model)
            top = lp.max(axis=1, keepdims=True)
            den = top + np.log(np.exp(lp - top).sum(axis=1, keepdims=True))
            ll += float(den.sum())
            r = np.exp(lp - den)
            for j in range(k):
                off = x - model["means"][j]
                total[j] += np.concatenate([[r[:, j].sum()], r[:, j] @ off, ((off * r[:, j:j + 1]).T @ off).ravel()])
        yield pd.DataFrame({"at": np.arange(total.size + 1), "v": np.concatenate([[ll], total.ravel()])})
    return run


def _diag_densities(x: np.ndarray, weights: np.ndarray, means: np.ndarray, variances: np.ndarray) -> np.ndarray:
    """Weighted log densities (rows x components) of a diagonal model."""
    return np.stack([np.log(w) - 0.5 * np.log(2 * np.pi * v).sum() - 0.5 * ((x - m) ** 2 / v).sum(axis=1)
                     for w, m, v in zip(weights, means, variances)], axis=1)


def _diag_sums(weights: np.ndarray, means: np.ndarray, variances: np.ndarray):
    """Per task: log likelihood (place 0) and, per component, weight and weighted sums of x and x^2."""
    def run(batches):
        k, d = means.shape
        total, ll = np.zeros((k, 1 + 2 * d)), 0.0
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.array(pdf["x"].tolist(), dtype=float)
            lp = _diag_densities(x, weights, means, variances)
            top = lp.max(axis=1, keepdims=True)
            e = np.exp(lp - top)
            den = e.sum(axis=1, keepdims=True)
            ll += float((top + np.log(den)).sum())
            r = (e / den).T
            total += np.hstack([r.sum(axis=1, keepdims=True), r @ x, r @ (x * x)])
        yield pd.DataFrame({"at": np.arange(total.size + 1), "v": np.concatenate([[ll], total.ravel()])})
    return run


def _gmm_full(df: DataFrame, array_col: str, k: int, max_iter: int, seed: int, tol: float, ridge: float) -> dict:
    ship_package(df.sparkSession)
    x = F.col(array_col).cast("array<double>")
    data = cut_lineage(df.select(x.alias("x")).where("x is not null"))
    glob = data.select(array_to_vector("x").alias("v")).agg(
        F.count(F.lit(1)).alias("n"), Summarizer.variance(F.col("v")).alias("var")).first()
    n = glob["n"]
    if n < k:
        raise ValueError("fewer rows than components")
    var = glob["var"].toArray()
    d = len(var)
    add = np.eye(d) * (ridge * float(var.mean()) or 1e-12)
    mu = np.array(cluster_kmeans(with_vector(data, "x"), k, n_init=1, max_iter=20, seed=seed).clusterCenters())
    if len(mu) < k:
        raise ValueError("fewer distinct rows than components")
    model = {"weights": np.full(k, 1.0 / k), "means": mu, "covariances": np.tile(np.diag(var) + add, (k, 1, 1))}
    prev = None
    for _ in range(max_iter):
        sums = data.mapInPandas(_gmm_sums(model), "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
        flat = sums.sort_values("at")["v"].to_numpy()
        ll, total = flat[0] / n, flat[1:].reshape(k, 1 + d + d * d)
        means, covs = model["means"].copy(), model["covariances"].copy()
        for j in range(k):
            if total[j, 0] > 1e-9:  # a component without rows stays where it is
                step = total[j, 1:1 + d] / total[j, 0]
                means[j] += step
                covs[j] = total[j, 1 + d:].reshape(d, d) / total[j, 0] - np.outer(step, step) + add
        model = {"weights": total[:, 0] / total[:, 0].sum(), "means": means, "covariances": covs}
        if prev is not None and abs(ll - prev) < tol:
            break
        prev = ll
    return model


def cluster_gmm(df: DataFrame, array_col: str, k: int = 8, covariance_type: str = "full",
                max_iter: int = 100, seed: int = 42, tol: float = 1e-3, ridge: float = 1e-3):
    """Gaussian mixture.  ``full``: EM with full covariances over all
    coordinates, from k-means centres; its sufficient statistics are summed per
    task with numpy and then by place (k x (1 + d + d^2) numbers reach the
    driver).  ``ridge`` times the mean variance of the coordinates is added to
    the diagonal of every covariance, so that fewer rows than coordinates, or
    constant coordinates, leave it invertible; null vectors are left out of the
    fit.  It ends when the mean log likelihood moves by less than ``tol``.
    ``diag`` / ``spherical`` / ``tied``: EM with diagonal covariances whose
    sufficient statistics (weighted sums of x and x^2 per component) are summed
    the same way; ``spherical`` averages the variances over
    dimensions, ``tied`` pools them over components (a diagonal tied
    covariance, an approximation of the full tied one)."""
    if covariance_type == "full":
        return _gmm_full(df, array_col, k, max_iter, seed, tol, ridge)
    if covariance_type not in ("diag", "spherical", "tied"):
        raise ValueError(f"unknown covariance_type {covariance_type!r}")
    x = F.col(array_col).cast("array<double>")
    d = len(df.select(x).first()[0])
    mu = _hash_seeds(df, x, k, seed)
    glob = df.select(array_to_vector(x).alias("v")).agg(
        Summarizer.variance(F.col("v")).alias("var")).first()["var"].toArray()
    var = np.tile(np.maximum(glob, 1e-6), (k, 1))
    w = np.full(k, 1.0 / k)
    ship_package(df.sparkSession)
    data = cut_lineage(df.select(x.alias("x")).where("x is not null"))
    prev = None
    for _ in range(max_iter):
        sums = data.mapInPandas(_diag_sums(w, mu, var), "at int, v double").groupBy("at").agg(F.sum("v").alias("v"))
        flat = sums.toPandas().sort_values("at")["v"].to_numpy()
        ll, total = flat[0], flat[1:].reshape(k, 1 + 2 * d)
        nk = total[:, 0]
        if not (nk > 0).all():
            raise ValueError("a component without rows")
        mu, ex2 = total[:, 1:1 + d] / nk[:, None], total[:, 1 + d:] / nk[:, None]
        var = np.maximum(ex2 - mu * mu, 1e-6)
        if covariance_type == "spherical":
            var = np.repeat(var.mean(axis=1, keepdims=True), d, axis=1)
        elif covariance_type == "tied":
            pooled = (var * nk[:, None]).sum(axis=0) / nk.sum()
            var = np.tile(pooled, (k, 1))
        w = nk / nk.sum()
        if prev is not None and abs(ll - prev) < tol * abs(prev):
            break
        prev = ll
    return {"weights": w, "means": mu, "variances": var}


def gmm_predict(df: DataFrame, array_col: str, model: dict) -> DataFrame:
    """Most likely component by a numpy function of the vector (null vector: 0
    under a diagonal model, null under a full one)."""
    if "covariances" in model:
        ship_package(df.sparkSession)

        def best(xs: pd.Series) -> pd.Series:
            out = pd.Series([None] * len(xs), dtype="Int32")
            has = xs.notna().to_numpy()
            if has.any():
                out[has] = _log_densities(np.array(xs[has].tolist(), dtype=float), model).argmax(axis=1)
            return out

        return df.withColumn("cluster", F.pandas_udf(best, "int")(F.col(array_col).cast("array<double>")))
    ship_package(df.sparkSession)

    def nearest(xs: pd.Series) -> pd.Series:
        out = pd.Series(np.zeros(len(xs), np.int32))
        has = xs.notna().to_numpy()
        if has.any():
            x = np.array(xs[has].tolist(), dtype=float)
            out[has] = _diag_densities(x, model["weights"], model["means"], model["variances"]).argmax(axis=1)
        return out

    return df.withColumn("cluster", F.pandas_udf(nearest, "int")(F.col(array_col).cast("array<double>")))


def _linkage_merge(centres: np.ndarray, weights: np.ndarray, k: int, linkage: str) -> np.ndarray:
    """Agglomerate the (few hundred) weighted micro-centres to ``k`` groups."""
    groups = [[i] for i in range(len(centres))]
    dist = np.sqrt(((centres[:, None, :] - centres[None, :, :]) ** 2).sum(-1))

    def gdist(a, b):
        if linkage == "ward":
            wa, wb = weights[a].sum(), weights[b].sum()
            ca = (centres[a] * weights[a][:, None]).sum(0) / wa
            cb = (centres[b] * weights[b][:, None]).sum(0) / wb
            return wa * wb / (wa + wb) * ((ca - cb) ** 2).sum()
        sub = dist[np.ix_(a, b)]
        if linkage == "complete":
            return sub.max()
        return (sub * np.outer(weights[a], weights[b])).sum() / (weights[a].sum() * weights[b].sum())

    while len(groups) > k:
        best = None
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                dd = gdist(groups[i], groups[j])
                if best is None or dd < best[0]:
                    best = (dd, i, j)
        _, i, j = best
        groups[i] = groups[i] + groups[j]
        groups.pop(j)
    label = np.zeros(len(centres), int)
    order = sorted(range(len(groups)), key=lambda g: min(groups[g]))
    for new, g in enumerate(order):
        label[groups[g]] = new
    return label


def cluster_agglomerative(df: DataFrame, array_col: str, k: int = 2, linkage: str = "ward",
                          micro: int = 200, seed: int = 42, id_col: str | None = None,
                          threshold: float | None = None) -> DataFrame:
    """Agglomerative clustering.

    ``single`` linkage is exact: a minimum spanning forest over rows named by
    ``id_col``, cut to ``k`` clusters or at ``threshold`` (see ``linkage``).
    The other linkages take two phases: k-means micro-clusters on Spark,
    linkage over the ``micro`` weighted centres on the driver (bounded by
    ``micro``), micro-cluster -> cluster applied as an expression; an
    approximation of row-level linkage, exact when ``micro`` >= distinct rows."""
    if linkage == "single":
        if id_col is None:
            raise ValueError("single linkage needs id_col")
        from loomkit.operators.linkage import cluster_single
        return cluster_single(df, array_col, id_col, k, threshold)
    v = with_vector(df, array_col)
    km = KMeans(k=micro, seed=seed, maxIter=50).fit(v)
    counts = km.transform(v).groupBy("prediction").count().collect()
    w = np.zeros(micro)
    for r in counts:
        w[int(r["prediction"])] = r["count"]
    live = np.where(w > 0)[0]
    centres = np.array(km.clusterCenters())[live]
    lab = _linkage_merge(centres, w[live], min(k, len(live)), linkage)
    m = F.create_map(*[x for i, c in zip(live, lab) for x in (F.lit(int(i)), F.lit(int(c)))])
    return km.transform(v).withColumn("cluster", m[F.col("prediction")]) \
             .drop("prediction", "features")


def cluster_counts(labelled: DataFrame, cluster: str = "cluster") -> DataFrame:
    return labelled.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))


def kmeans_labels(model, df: DataFrame, array_col: str) -> DataFrame:
    return model.transform(with_vector(df, array_col)).withColumnRenamed(
        "prediction", "cluster").drop("features")


__all__ = ["cluster_kmeans", "cluster_minibatch_kmeans", "cluster_gmm", "gmm_predict",
           "cluster_agglomerative", "assign_nearest", "knn_predict", "cluster_counts", "kmeans_labels",
           "with_vector", "vector_to_array", "pd"]
