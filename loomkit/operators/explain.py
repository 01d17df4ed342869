"""Attribution: linear closed-form SHAP, aggregation of attribution tensors,
top-k importances, permutation importance and sampled (Monte-Carlo) SHAP.

Permutation importance shuffles a column with two independent hash orders
ranked exactly by ``rank_within_groups`` (no single-task window), then joins
position to position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomkit.functions.exprs import hash_unit
from loomkit.operators.splits import rank_within_groups


def shap_linear(df: DataFrame, coefficients: dict[str, float]) -> DataFrame:
    """Mean |coef_j (x_j - mean x_j)| per feature (exact for linear models)."""
    means = df.agg(*[F.avg(c).alias(c) for c in coefficients]).first()
    parts = [F.struct(F.lit(c).alias("feature"),
                      F.abs(F.lit(float(w)) * (F.col(c) - F.lit(float(means[c])))).alias("v"))
             for c, w in coefficients.items()]
    long = df.select(F.explode(F.array(*parts)).alias("p")).select("p.*")
    return long.groupBy("feature").agg(F.avg("v").alias("importance"))


def shap_aggregate(values: DataFrame, feature: str = "feature", value: str = "value"
                   ) -> DataFrame:
    """(row, feature, class) attributions -> mean absolute value per feature."""
    return values.groupBy(feature).agg(F.avg(F.abs(F.col(value))).alias("importance"))


def importance_top(importances: DataFrame, n: int = 20, value: str = "importance",
                   feature: str = "feature") -> DataFrame:
    """The ``n`` largest importances (ties by feature name); a per-partition top-n."""
    return importances.orderBy(F.col(value).desc(), F.col(feature)).limit(n)


def permute_column(df: DataFrame, col: str, key_cols: list[str], seed: int = 7) -> DataFrame:
    """Return ``df`` with ``col`` shuffled among rows (exact permutation).

    Rows are ranked twice by two independent hashes of the key; the value at
    position p of the second order moves to the row at position p of the
    first.  Both ranks are bucketed prefix counts; the move is one join."""
    a = rank_within_groups(df, [], hash_unit(seed, *key_cols), key_cols) \
        .withColumnRenamed("_pos", "_p").drop("_u", "_n")
    b = rank_within_groups(df.select(*key_cols, col), [], hash_unit(seed + 1, *key_cols),
                           key_cols).select(F.col("_pos").alias("_p"), F.col(col).alias("_new"))
    return a.join(b, "_p").withColumn(col, F.col("_new")).drop("_p", "_new")


def permutation_importance(model, df: DataFrame, feature_cols: list[str], key_cols: list[str],
                           assemble, score, seed: int = 7) -> DataFrame:
    """Metric drop when one feature is shuffled: ``score(model.transform(...))``
    is a one-row metric frame; ``assemble`` builds the model input."""
    spark = df.sparkSession
    base = score(model.transform(assemble(df))).first()[0]
    rows = []
    for i, c in enumerate(feature_cols):
        v = score(model.transform(assemble(permute_column(df, c, key_cols, seed + 10 * i)))) \
            .first()[0]
        rows.append((c, float(base - v)))
    return spark.createDataFrame(rows, "feature string, importance double")


def shap_sampled(model, explain: DataFrame, background: DataFrame, feature_cols: list[str],
                 assemble, n_permutations: int = 10, seed: int = 42,
                 output: str = "prediction") -> DataFrame:
    """Monte-Carlo Shapley values (permutation sampling).

    For each explained row, permutation and background row, feature j's
    contribution is f(x_S + j) - f(x_S), where S are the features before j in
    the permutation and the rest come from the background row.  All
    coalitions are one exploded frame scored by ONE ``model.transform``; the
    difference along the permutation is a window over at most d rows."""
    from pyspark.sql import Window

    d = len(feature_cols)
    ex = explain.select(F.monotonically_increasing_id().alias("_row"),
                        F.array(*[F.col(c).cast("double") for c in feature_cols]).alias("_x"))
    bg = background.select(F.array(*[F.col(c).cast("double") for c in feature_cols]).alias("_z"))
    # background rows numbered 0..n-1 (the background is a small, capped sample)
    bg = bg.withColumn("_b", F.row_number().over(Window.orderBy(F.xxhash64("_z"), "_z")) - 1)
    # the seeded permutations (n_permutations x d, bounded) travel as a literal array
    import numpy as np

    rng = np.random.default_rng(seed)
    orders = [rng.permutation(d).tolist() for _ in range(n_permutations)]
    perms = F.array(*[F.struct(F.lit(i).alias("_perm"),
                               F.array(*[F.lit(int(v)) for v in o]).alias("_order"))
                      for i, o in enumerate(orders)])
    # one background row per (row, permutation), picked by hash
    n_bg = bg.count()
    pairs = ex.select("*", F.explode(perms).alias("_pp")).select("*", "_pp._perm", "_pp._order") \
              .drop("_pp").withColumn("_b", F.pmod(F.xxhash64("_row", "_perm", F.lit(seed)),
                                                   F.lit(n_bg)))
    pairs = pairs.join(F.broadcast(bg), "_b")
    steps = pairs.select("*", F.posexplode(F.sequence(F.lit(0), F.lit(d))).alias("_k", "_kk"))
    # coalition after k steps: features order[0..k-1] from x, the rest from z
    taken = F.slice(F.col("_order"), 1, F.col("_k"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(d - 1)),
                      lambda i: F.when(F.array_contains(taken, i), F.element_at("_x", i + 1))
                      .otherwise(F.element_at("_z", i + 1)))
    coal = steps.withColumn("_v", vec)
    cols = [F.element_at("_v", i + 1).alias(c) for i, c in enumerate(feature_cols)]
    scored = model.transform(assemble(coal.select("_row", "_perm", "_k", "_order", *cols)))
    w = Window.partitionBy("_row", "_perm").orderBy("_k")
    delta = scored.withColumn("_d", F.col(output) - F.lag(output).over(w)) \
                  .where(F.col("_k") > 0) \
                  .withColumn("_j", F.element_at("_order", F.col("_k")))
    names = F.array(*[F.lit(c) for c in feature_cols])
    per = delta.groupBy("_row", "_j").agg(F.avg("_d").alias("value"))
    return per.select("_row", F.element_at(names, F.col("_j") + 1).alias("feature"),
                      "value")
