"""Neighbourhood recommendation: weighted mean of the ``k`` most similar raters.

Similarities are sums over shared items (or users), built from an inverted
index: the ratings of the asked users meet the ratings of all users on the
item, and partial sums per pair are combined before the shuffle.  Only asked
users are on the left side, so the work follows the stated query set, and of
the pairs that meet only those go on in which the other user rated an asked
item: an asked user's rows carry short hashes of these raters, so that nearly
all other pairs end where they are made.  Long posting lists are dealt over
salts; a user with very many ratings is only as many short lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomkit.functions.exprs import with_scalars
from loomkit.operators.recommend import baseline_biases, reco_rating_bounds
from loomkit.session import written

POSTING = 10_000  # ratings of one item that one task holds against the asked ones
HASHES = 256  # distinct hashes of raters up to which an asked user's rows carry them; beyond, all pairs are summed
SIMILARITIES = ("cosine", "msd", "pearson", "pearson_baseline")


def _similarity(name: str, shrinkage: float) -> Column:
    n, xy, xx, yy, x, y, dd = (F.col(c) for c in ("n", "sxy", "sxx", "syy", "sx", "sy", "sdd"))
    if name == "cosine":
        value = F.try_divide(xy, F.sqrt(xx * yy))
    elif name == "msd":
        value = 1 / (dd / n + 1)
    elif name == "pearson":
        value = F.try_divide(n * xy - x * y, F.sqrt((n * xx - x * x) * (n * yy - y * y)))
    else:  # residuals of the biases, shrunk where few items are shared
        value = F.try_divide(xy, F.sqrt(xx * yy)) * (n - 1) / (n - 1 + shrinkage)
    return F.when(F.col("a") == F.col("b"), F.lit(1.0)).otherwise(F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0)))


def _hash(c: str) -> Column:
    return (F.pmod(F.xxhash64(c), F.lit(65536)) - 32768).cast("smallint")


def _similar(rows: DataFrame, wanted: DataFrame, name: str, shrinkage: float) -> DataFrame:
    """``(a, b, sim)`` of every pair of ``wanted`` that shares a key ``y``, and of some other such pairs."""
    few = wanted.groupBy("a").agg(F.collect_set(_hash("b")).alias("h")) \
        .select(F.col("a").alias("x"), F.when(F.size("h") <= HASHES, F.col("h")).alias("h"))
    # a row for POSTING ratings at most
    long = rows.groupBy("y").agg(F.ceil(F.count(F.lit(1)) / POSTING).cast("int").alias("salts")).where("salts > 1")
    rows = rows.join(F.broadcast(long), "y", "left").fillna(1, ["salts"])
    left = rows.join(few, "x").select("y", F.col("x").alias("a"), F.col("v").alias("va"), "h",
                                      F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    right = rows.select("y", F.col("x").alias("b"), F.col("v").alias("vb"),
                        F.pmod(F.xxhash64("x"), F.col("salts")).cast("int").alias("salt"))
    p, q = F.col("va"), F.col("vb")
    met = left.join(right, ["y", "salt"]).where(F.col("h").isNull() | F.array_contains("h", _hash("b")))
    sums = met.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n"), F.sum(p * q).alias("sxy"), F.sum(p * p).alias("sxx"), F.sum(q * q).alias("syy"),
        F.sum(p).alias("sx"), F.sum(q).alias("sy"), F.sum((p - q) * (p - q)).alias("sdd"))
    return sums.select("a", "b", _similarity(name, shrinkage).alias("sim"))


def reco_knn(ratings: DataFrame, pairs: DataFrame, k: int = 40, min_k: int = 1, sim: str = "cosine",
             user_based: bool = True, shrinkage: float = 100.0) -> DataFrame:
    """``(user_id, item_id, neighbours, prediction)`` of the distinct asked pairs.

    ``ratings`` has ``user_id, item_id, rating``; repeated pairs count at their
    mean, rows with a null are left out.  A prediction is the mean rating of the
    ``k`` most similar raters of the item weighted by similarity (ties: the
    smaller id), over those of positive similarity.  With fewer than ``min_k``
    of them, and for unknown users or items, it is the mean of all ratings.
    Predictions are clipped to the range of the ratings.  ``user_based=False``
    swaps users and items.
    """
    if sim not in SIMILARITIES:
        raise ValueError(f"sim={sim!r}")
    x, y = ("user_id", "item_id") if user_based else ("item_id", "user_id")
    told = written(ratings.select("user_id", "item_id", F.col("rating").cast("double").alias("rating")).dropna()
                       .groupBy("user_id", "item_id").agg(F.avg("rating").alias("rating")))
    value = F.col("rating")
    base = told
    if sim == "pearson_baseline":
        mu, of_item, of_user = baseline_biases(told)
        base = with_scalars(told.join(of_item, "item_id").join(of_user, "user_id"), mu)
        value = F.col("rating") - F.col("mu") - F.col("b_item") - F.col("b_user")
    rows = base.select(F.col(x).alias("x"), F.col(y).alias("y"), value.alias("v"))
    asked = written(pairs.select(F.col(x).alias("a"), F.col(y).alias("y")).distinct())
    known = asked.join(told.select(F.col(x).alias("a")).distinct(), "a", "left_semi")
    raters = known.join(told.select(F.col(x).alias("b"), F.col(y).alias("y"), "rating"), "y")
    sims = _similar(rows, raters.select("a", "b"), sim, shrinkage)
    best = Window.partitionBy("a", "y").orderBy(F.desc("sim"), "b")
    near = raters.join(sims, ["a", "b"]).withColumn("rank", F.row_number().over(best)) \
        .where((F.col("rank") <= k) & (F.col("sim") > 0))
    said = near.groupBy("a", "y").agg(F.count(F.lit(1)).alias("neighbours"),
                                      (F.sum(F.col("sim") * F.col("rating")) / F.sum("sim")).alias("p"))
    scale = told.agg(F.avg("rating").alias("_mean"))
    out = with_scalars(with_scalars(asked.join(said, ["a", "y"], "left"), scale), reco_rating_bounds(told))
    enough = F.coalesce("neighbours", F.lit(0)) >= F.lit(max(1, min_k))
    return out.select(F.col("a").alias(x), F.col("y").alias(y), F.coalesce("neighbours", F.lit(0)).alias("neighbours"),
                      F.least(F.greatest(F.when(enough, F.col("p")).otherwise(F.col("_mean")), "r_min"), "r_max")
                      .alias("prediction")).select("user_id", "item_id", "neighbours", "prediction")
