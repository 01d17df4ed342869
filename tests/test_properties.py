"""Property tests in the spirit of the reference's leakage tests: splits are
disjoint, complete and stable; fitted statistics come from train only; exact
helpers equal brute force; top-k never returns a seen item."""

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomkit.functions.prefix import dense_index, prefix_sums
from loomkit.operators import series as S
from loomkit.operators import splits as SP
from loomkit.operators import transforms as TF
from loomkit.session import load_table
from tests.conftest import SMALL


def test_split_complete_disjoint_and_stable(spark):
    o = load_table(spark, SMALL, "orders").select("o_orderkey", "o_orderpriority")
    a = SP.split_stratified(o, "o_orderpriority", ["o_orderkey"], 0.6, 0.2, 0.2, seed=3)
    b = SP.split_stratified(o.repartition(7), "o_orderpriority", ["o_orderkey"], 0.6, 0.2, 0.2,
                            seed=3)
    pa = a.toPandas().sort_values("o_orderkey").reset_index(drop=True)
    pb = b.toPandas().sort_values("o_orderkey").reset_index(drop=True)
    assert len(pa) == o.count() and pa["o_orderkey"].is_unique
    assert (pa["split"] == pb["split"]).all()
    share = pa.groupby("o_orderpriority")["split"].apply(lambda s: (s == "train").mean())
    assert ((share - 0.6).abs() < 0.02).all()


def test_rank_within_groups_matches_row_number(spark):
    ev = load_table(spark, SMALL, "events")
    from loomkit.functions.exprs import hash_unit
    got = SP.rank_within_groups(ev, ["event_type"], hash_unit(1, "event_id"), ["event_id"],
                                buckets=16).select("event_id", "_pos").toPandas()
    w = Window.partitionBy("event_type").orderBy(hash_unit(1, "event_id"), "event_id")
    want = ev.select("event_id", (F.row_number().over(w) - 1).alias("_pos")).toPandas()
    m = got.merge(want, on="event_id")
    assert len(m) == len(want) and (m["_pos_x"] == m["_pos_y"]).all()


def test_prefix_sums_and_dense_index_brute_force(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"k": rng.permutation(500).astype(float), "v": rng.integers(0, 9, 500)})
    df = spark.createDataFrame(pdf)
    got = prefix_sums(df, "k", ["v"], buckets=7).toPandas().sort_values("k")
    exp = pdf.sort_values("k")["v"].cumsum().shift(fill_value=0).to_numpy()
    assert (got["before_v"].to_numpy() == exp).all()
    idx = dense_index(df, "k", buckets=5).toPandas().sort_values("k")
    assert (idx["idx"].to_numpy() == np.arange(500)).all()


def test_fit_statistics_come_from_train_only(spark):
    li = load_table(spark, SMALL, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    train = li.where(F.col("l_orderkey") % 2 == 0)
    o = TF.ColumnOp("l_quantity", "standard_scale", {}, key="k")
    TF.fit_ops(train, [o])
    mean_before = o.stats["k__mean"]
    # mutating the non-train rows must not move the fitted statistics
    mutated = li.withColumn("l_quantity", F.when(F.col("l_orderkey") % 2 == 1, 1e6)
                            .otherwise(F.col("l_quantity")))
    o2 = TF.ColumnOp("l_quantity", "standard_scale", {}, key="k")
    TF.fit_ops(mutated.where(F.col("l_orderkey") % 2 == 0), [o2])
    assert o2.stats["k__mean"] == mean_before
    scaled = TF.apply_ops(train, [o]).agg(F.avg("l_quantity"), F.var_pop("l_quantity")).first()
    assert abs(scaled[0]) < 1e-9 and abs(scaled[1] - 1) < 1e-9


def test_min_max_constant_and_unknown_categories(spark):
    df = spark.createDataFrame([(1, 5.0, "a"), (2, 5.0, "b")], "id int, x double, c string")
    o = TF.ColumnOp("x", "min_max", {"feature_range": (2, 3)}, key="m")
    e = TF.ColumnOp("c", "ordinal", {}, key="o")
    h = TF.ColumnOp("c", "one_hot", {}, key="h")
    TF.fit_ops(df, [o, e, h])
    new = spark.createDataFrame([(3, 5.0, "z")], "id int, x double, c string")
    r = TF.apply_ops(new, [o, e, h]).first()
    assert r[0] == 2.0 and r[1] == -1.0 and r[2] == 0.0 and r[3] == 0.0


def test_arima_recovers_ar1(spark):
    rng = np.random.default_rng(1)
    y = np.zeros(400)
    for t in range(1, 400):
        y[t] = 0.7 * y[t - 1] + rng.normal()
    fc = S.arima_forecast(y, 3, p=1)
    assert abs(fc[0] - 0.7 * y[-1]) < 0.15 * abs(y[-1]) + 0.2


def test_top_k_never_returns_seen(spark):
    from loomkit.plans.q_reco import _top_k
    recs, _ = _top_k(spark, SMALL, 5)
    from loomkit.plans.q_reco import ratings_split
    train, _ = ratings_split(spark, SMALL)
    clash = recs.join(train.select("user_id", "item_id"), ["user_id", "item_id"])
    assert clash.count() == 0


def test_exact_median_matches_numpy(spark):
    from loomkit.functions.prefix import exact_median
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 400, 401):
        vals = rng.integers(0, 50, n).astype(float)
        df = spark.createDataFrame(pd.DataFrame({"x": vals}))
        assert exact_median(df, "x", buckets=6) == float(np.median(vals))


def test_als_top_k_equals_brute_force(spark):
    from loomkit.operators import recommend as RC
    from loomkit.plans.q_reco import ratings_split
    train, _ = ratings_split(spark, SMALL)
    tr = train.select("user_id", "item_id", "rating")
    model, users, items = RC.reco_als_implicit(tr, factors=4, iterations=3)
    seen = tr.join(users, "user_id").join(items, "item_id").select(
        F.col("user_idx").alias("user_id"), F.col("item_idx").alias("item_id"))
    uidx = users.select(F.col("user_idx").alias("user_id"))
    got = RC.reco_top_k_als(model, uidx, seen, 3, light_quantile=0.5) \
            .select("user_id", "item_id", "rank").toPandas()
    n_items = items.count()
    full = model.recommendForUserSubset(uidx.withColumnRenamed("user_id", "user_idx"), n_items) \
        .select(F.col("user_idx").alias("user_id"), F.explode("recommendations").alias("r")) \
        .select("user_id", F.col("r.item_idx").alias("item_id"), F.col("r.rating").alias("score"))
    unseen = full.join(seen, ["user_id", "item_id"], "left_anti")
    w = Window.partitionBy("user_id").orderBy(F.col("score").desc(), "item_id")
    want = unseen.withColumn("rank", F.row_number().over(w) - 1).where("rank < 3") \
                 .select("user_id", "item_id", "rank").toPandas()
    key = ["user_id", "rank"]
    a = got.sort_values(key).reset_index(drop=True)
    b = want.sort_values(key).reset_index(drop=True)
    assert len(a) == len(b) and (a["item_id"].to_numpy() == b["item_id"].to_numpy()).all()
