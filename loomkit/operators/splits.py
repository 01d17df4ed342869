"""Leak-free splits and deterministic sampling.

All splits are hash splits: ``u = hash_unit(seed, key)`` is a pure function of
the row key, so the assignment is order-free, stable under repartitioning and
recomputation (a lost executor recomputes the same rows into the same split),
and DuckDB computes the same value.

Ranks inside a group never run a whole group in one task: ``u`` is uniform, so
equal-width ``u`` buckets split even a group holding a third of the table into
balanced pieces; per-(group, bucket) counts (a tiny table) give each piece its
offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomkit.functions.exprs import hash_unit, split_bucket

SPLIT_NAMES = ("train", "val", "test")


def _fractions(train: float, val: float, test: float) -> list[float]:
    total = float(train) + float(val) + float(test)
    if total <= 0:
        raise ValueError("split fractions sum to zero or less")
    return [train / total, val / total, test / total]


def _row_unit(df: DataFrame, seed: int) -> Column:
    """Uniform number from a whole row, for rows whose key is NULL."""
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns]), F.lit(2**32)) / F.lit(2.0**32)


def split_three_way(df: DataFrame, key_cols: list[str], train: float = 0.7,
                    val: float = 0.15, test: float = 0.15, seed: int = 42,
                    out: str = "split") -> DataFrame:
    """Tag every row ``train`` / ``val`` / ``test`` by cumulative fractions of ``u``."""
    fr = _fractions(train, val, test)
    u = F.coalesce(hash_unit(seed, *key_cols), _row_unit(df, seed))
    return df.withColumn(out, split_bucket(u, fr, list(SPLIT_NAMES)))


def rank_within_groups(df: DataFrame, group_cols: list[str], u: Column,
                       tie_cols: list[str], buckets: int | None = None) -> DataFrame:
    """Add ``_pos`` (0-based rank by ``u, tie_cols`` inside the group) and ``_n``.

    ``u`` must be uniform in [0, 1).  The big window is partitioned by
    (group, u-bucket), never by the group alone.  The bucket count follows the
    cluster's shuffle width (twice ``spark.sql.shuffle.partitions``, at least
    64), so a group holding a third of the table is cut into as many pieces
    as there are reduce tasks; only non-empty (group, bucket) pairs exist in
    the count table.
    """
    if not buckets:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
        buckets = max(64, 2 * parts)
    t = df.withColumn("_u", u).withColumn(
        "_ub", F.least(F.floor(F.col("_u") * buckets), F.lit(buckets - 1)).cast("int"))
    counts = t.groupBy(*group_cols, "_ub").agg(F.count(F.lit(1)).alias("_cnt"))
    w_off = Window.partitionBy(*group_cols).orderBy("_ub").rowsBetween(
        Window.unboundedPreceding, -1)
    w_tot = Window.partitionBy(*group_cols)
    # counts has at most groups x buckets rows; its per-group windows are small
    offs = counts.select(*group_cols, "_ub",
                         F.coalesce(F.sum("_cnt").over(w_off), F.lit(0)).alias("_off"),
                         F.sum("_cnt").over(w_tot).alias("_n"))
    w_in = Window.partitionBy(*group_cols, "_ub").orderBy("_u", *tie_cols)
    joined = t.join(offs, [*group_cols, "_ub"], "inner")
    return joined.withColumn("_pos", F.col("_off") + F.row_number().over(w_in) - 1) \
                 .drop("_ub", "_off")


def split_stratified(df: DataFrame, label: str, key_cols: list[str], train: float = 0.7,
                     val: float = 0.15, test: float = 0.15, seed: int = 42,
                     out: str = "split") -> DataFrame:
    """Same proportions inside every class.

    Inside a class of ``n`` rows ordered by ``(u, key)``, position ``p`` goes
    to train when ``p < n * train``, to val when ``p < n * (train + val)``,
    else test.
    """
    fr = _fractions(train, val, test)
    keystr = F.concat_ws("|", *[F.col(k).cast("string") for k in key_cols])
    ranked = rank_within_groups(df.withColumn("_key", keystr), [label],
                                hash_unit(seed, "_key"), ["_key"])
    p, n = F.col("_pos"), F.col("_n")
    tag = (F.when(p < n * F.lit(fr[0]), "train")
            .when(p < n * F.lit(fr[0] + fr[1]), "val").otherwise("test"))
    return ranked.withColumn(out, tag).drop("_u", "_pos", "_n", "_key")


def split_holdout(df: DataFrame, key_cols: list[str], val_fraction: float = 0.2,
                  seed: int = 42, n_rows: int | None = None, out: str = "split", keep_up_to: int = 10) -> DataFrame:
    """Unsupervised hold-out: val fraction clamped to [0, 0.5]; up to ``keep_up_to``
    rows all stay train.

    ``n_rows`` can be passed when known; otherwise one count is run.
    """
    frac = min(max(float(val_fraction), 0.0), 0.5)
    n = df.count() if n_rows is None else n_rows
    if n <= keep_up_to or frac == 0.0:
        return df.withColumn(out, F.lit("train"))
    u = hash_unit(seed, *key_cols)
    return df.withColumn(out, F.when(u < F.lit(1.0 - frac), "train").otherwise("val"))


def split_ratings_random(df: DataFrame, key_cols: list[str], test: float = 0.2,
                         seed: int = 42, out: str = "split") -> DataFrame:
    """80/20 row split of ratings (hash split)."""
    u = hash_unit(seed, *key_cols)
    return df.withColumn(out, F.when(u < F.lit(1.0 - test), "train").otherwise("test"))


def _last_rows_threshold(df: DataFrame, group_cols: list[str], order_cols: list[str],
                         n: int) -> DataFrame:
    """Per group, the smallest ``struct(order_cols)`` among its last ``n`` rows.

    ``n == 1`` is a plain ``max`` aggregate (map-side combine, no window).  For
    ``n > 1`` the ``row_number() <= n`` filter lets Spark insert a partial
    ``WindowGroupLimit`` before the shuffle, so at most ``n`` rows per group
    leave each map task, even for a group holding a third of the table.
    """
    ordv = F.struct(*[F.col(c) for c in order_cols])
    if n == 1:
        return df.groupBy(*group_cols).agg(F.max(ordv).alias("_thr"))
    w = Window.partitionBy(*group_cols).orderBy(*[F.col(c).desc() for c in order_cols])
    top = df.select(*group_cols, *order_cols).withColumn("_rn", F.row_number().over(w)) \
            .where(F.col("_rn") <= n)
    return top.groupBy(*group_cols).agg(F.min(F.struct(*[F.col(c) for c in order_cols]))
                                        .alias("_thr"))


def split_temporal(df: DataFrame, series_cols: list[str], order_cols: list[str],
                   horizon: int, out: str = "split") -> DataFrame:
    """The last ``horizon`` points of every series are ``val``, the rest ``train``."""
    if horizon < 1:
        raise ValueError("horizon must be >= 1")
    thr = _last_rows_threshold(df, series_cols, order_cols, horizon)
    ordv = F.struct(*[F.col(c) for c in order_cols])
    j = df.join(thr, series_cols, "left")
    return j.withColumn(out, F.when(ordv >= F.col("_thr"), "val").otherwise("train")) \
            .drop("_thr")


def split_last_interaction(df: DataFrame, user_col: str, order_cols: list[str],
                           out: str = "split") -> DataFrame:
    """The last interaction of every user is ``test`` (explicit order columns)."""
    return split_temporal(df, [user_col], order_cols, 1, out).withColumn(
        out, F.when(F.col(out) == "val", "test").otherwise("train"))


def sample_head_capped(df: DataFrame, key_cols: list[str], n: int = 200,
                       seed: int = 42) -> DataFrame:
    """A deterministic cap of ``n`` rows (order by the hash, then the key).

    The cap is the feature here (it bounds an expensive later step); Spark
    plans it as a ``TakeOrderedAndProject`` (per-partition top-n, no full sort).
    """
    u = hash_unit(seed, *key_cols)
    return df.withColumn("_u", u).orderBy("_u", *key_cols).limit(n).drop("_u")
