"""Queries for recommendation (survey 2.6) and its metrics (2.7).

Explicit ratings: orders join lineitem, user ``o_custkey``, item
``l_partkey``, rating ``l_quantity``; the last interaction of each user (by
order date, then the line key) is held out.  Implicit feedback: events, user
``user_id``, item ``event_type``, value ``value``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomkit.functions.exprs import r6
from loomkit.operators import metrics as M
from loomkit.operators import recommend as RC
from loomkit.operators.splits import split_last_interaction
from loomkit.plans.registry import register
from loomkit.session import cut_lineage, load_table, written

ORDER = ["o_orderdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]

_R_SQL = """(SELECT o_custkey AS user_id, l_partkey AS item_id, CAST(l_quantity AS DOUBLE) AS rating,
  o_orderdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_SPLIT_SQL = f"""h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY o_orderdate DESC,
    l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn
    FROM {_R_SQL}),
tr AS (SELECT * FROM h WHERE rn > 1), te AS (SELECT * FROM h WHERE rn = 1)"""


def ratings_raw(spark, sf):
    li = load_table(spark, sf, "lineitem")
    o = load_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))


def ratings_split(spark, sf):
    raw = ratings_raw(spark, sf)
    # the prepared roles plus the order columns of the hold-out
    full = raw.select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"),
                      F.col("l_quantity").cast("double").alias("rating"), *ORDER).dropna()
    # a join and a window over the whole table, read by every model and metric below: computed once
    s = written(split_last_interaction(full, "user_id", ORDER).select("user_id", "item_id", "rating", "split"))
    return (s.where(F.col("split") == "train").drop("split"),
            s.where(F.col("split") == "test").drop("split"))


@register("reco_prepare", f"SELECT user_id, item_id, rating FROM {_R_SQL}")
def q_reco_prepare(spark, sf):
    return RC.reco_prepare(ratings_raw(spark, sf), "o_custkey", "l_partkey", "l_quantity")


@register("reco_index_ids", f"""
SELECT 'user' AS kind, user_id AS id, CAST(row_number() OVER (ORDER BY user_id) - 1 AS BIGINT) AS idx
FROM (SELECT DISTINCT user_id FROM {_R_SQL})
UNION ALL
SELECT 'item', item_id, CAST(row_number() OVER (ORDER BY item_id) - 1 AS BIGINT)
FROM (SELECT DISTINCT item_id FROM {_R_SQL})""")
def q_reco_index_ids(spark, sf):
    r = RC.reco_prepare(ratings_raw(spark, sf), "o_custkey", "l_partkey", "l_quantity")
    users, items = RC.reco_index_ids(r)
    return users.select(F.lit("user").alias("kind"), F.col("user_id").alias("id"),
                        F.col("user_idx").alias("idx")).unionByName(
        items.select(F.lit("item").alias("kind"), F.col("item_id").alias("id"),
                     F.col("item_idx").alias("idx")))


@register("reco_rating_bounds", f"""
SELECT min(rating) AS r_min, CASE WHEN max(rating) = min(rating) THEN min(rating) + 1
  ELSE max(rating) END AS r_max FROM {_R_SQL}""")
def q_reco_rating_bounds(spark, sf):
    return RC.reco_rating_bounds(
        RC.reco_prepare(ratings_raw(spark, sf), "o_custkey", "l_partkey", "l_quantity"))


@register("reco_confidence", """
SELECT user_id, event_type AS item_id, round(sum(1.0 + 40.0 * value), 4) AS confidence
FROM events GROUP BY user_id, event_type""")
def q_reco_confidence(spark, sf):
    ev = RC.reco_prepare(load_table(spark, sf, "events"), "user_id", "event_type", "value")
    return RC.reco_confidence(ev, 40.0).withColumn("confidence", r6("confidence", 4))


_BASELINE_SQL = f"""WITH {_SPLIT_SQL},
mu AS (SELECT avg(rating) AS mu FROM tr),
bi AS (SELECT item_id, sum(rating - mu) / (count(*) + 10.0) AS b_item FROM tr, mu GROUP BY item_id),
bu AS (SELECT user_id, sum(rating - mu - b_item) / (count(*) + 15.0) AS b_user
       FROM tr JOIN bi USING (item_id), mu GROUP BY user_id),
b AS (SELECT min(rating) AS r_min, CASE WHEN max(rating) = min(rating) THEN min(rating) + 1
        ELSE max(rating) END AS r_max FROM tr),
p AS (SELECT te.rating, least(greatest(mu + coalesce(b_user, 0) + coalesce(b_item, 0), r_min), r_max)
        AS pred FROM te LEFT JOIN bi USING (item_id) LEFT JOIN bu USING (user_id), mu, b)"""


@register("metric_ratings", _BASELINE_SQL + """
SELECT round(sqrt(avg((rating - pred) * (rating - pred))), 6) AS rmse,
  round(avg(abs(rating - pred)), 6) AS mae FROM p""", digits=6)
def q_metric_ratings(spark, sf):
    train, test = ratings_split(spark, sf)
    mu, bi, bu = RC.baseline_biases(train)
    pred = RC.baseline_predict(test.select("user_id", "item_id", "rating"), mu, bi, bu,
                               RC.reco_rating_bounds(train))
    return M.ratings(pred, "rating", "prediction")


@register("reco_predict_pair", f"""WITH {_SPLIT_SQL},
mu AS (SELECT avg(rating) AS mu FROM tr),
uf AS (SELECT user_id, avg(rating) AS m FROM tr GROUP BY user_id),
itf AS (SELECT item_id, avg(rating) - (SELECT mu FROM mu) AS d FROM tr GROUP BY item_id),
pairs AS (SELECT user_id, item_id FROM te UNION ALL SELECT user_id, -1 FROM te)
SELECT pairs.user_id, pairs.item_id,
  round(CASE WHEN m IS NULL OR d IS NULL THEN 0.0 ELSE m * 1.0 + 1.0 * d END, 6) AS score
FROM pairs LEFT JOIN uf USING (user_id) LEFT JOIN itf USING (item_id)""")
def q_reco_predict_pair(spark, sf):
    train, test = ratings_split(spark, sf)
    users, items = RC.bias_factors(train.select("user_id", "item_id", "rating"))
    pairs = test.select("user_id", "item_id").unionByName(
        test.select("user_id", F.lit(-1).cast("bigint").alias("item_id")))
    return RC.reco_predict_pair(pairs, users, items).withColumn("score", r6("score"))


def _top_k_sql(k: int) -> str:
    return f"""{_SPLIT_SQL},
pop AS (SELECT item_id, count(DISTINCT user_id) AS score FROM tr GROUP BY item_id),
u AS (SELECT DISTINCT user_id FROM tr),
seen AS (SELECT DISTINCT user_id, item_id FROM tr),
c AS (SELECT u.user_id, pop.item_id, score FROM u, pop
      WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.user_id = u.user_id AND seen.item_id = pop.item_id)),
r AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) - 1
      AS rank FROM c),
top AS (SELECT user_id, item_id, CAST(rank AS BIGINT) AS rank FROM r WHERE rank < {k})"""


def _top_k(spark, sf, k):
    train, test = ratings_split(spark, sf)
    train = cut_lineage(train.select("user_id", "item_id"))  # read three times below
    pop = train.groupBy("item_id").agg(F.count_distinct("user_id").alias("score"))
    recs = RC.reco_top_k_global(train.select("user_id"), pop, train, k)
    return recs.withColumn("rank", F.col("rank").cast("bigint")), test


@register("reco_top_k", "WITH " + _top_k_sql(5) + " SELECT * FROM top")
def q_reco_top_k(spark, sf):
    recs, _ = _top_k(spark, sf, 5)
    return recs.select("user_id", "item_id", "rank")


@register("metric_ranking_at_k", "WITH " + _top_k_sql(10) + """,
rel AS (SELECT DISTINCT user_id, item_id FROM te),
nrel AS (SELECT user_id, count(*) AS n_rel FROM rel GROUP BY user_id),
hits AS (SELECT user_id, count(*) AS hits, sum(1.0 / log2(rank + 2.0)) AS dcg
         FROM top JOIN rel USING (user_id, item_id) GROUP BY user_id),
per AS (SELECT nrel.user_id, n_rel, coalesce(hits, 0) AS hits, coalesce(dcg, 0.0) AS dcg,
          (SELECT sum(1.0 / log2(i + 2.0)) FROM range(0, least(10, n_rel)) t(i)) AS idcg
        FROM nrel LEFT JOIN hits USING (user_id))
SELECT round(avg(hits / 10.0), 6) AS precision_at_k, round(avg(hits / n_rel), 6) AS recall_at_k,
  round(avg(dcg / idcg), 6) AS ndcg_at_k, count(*) AS n_users FROM per""", digits=6)
def q_metric_ranking_at_k(spark, sf):
    recs, test = _top_k(spark, sf, 10)
    return M.ranking_at_k(recs, test, "user_id", "item_id", "rank", 10)


# ---------------------------------------------------------------- model fits (rows-only)

@register("reco_als_implicit")
def q_reco_als_implicit(spark, sf):
    # purchase quantities as implicit strength (events have too few items)
    train, _test = ratings_split(spark, sf)
    ev = train.select("user_id", "item_id", "rating")
    model, users, items = RC.reco_als_implicit(ev, factors=8, iterations=5)
    seen = ev.join(users, "user_id").join(items, "item_id").select(
        F.col("user_idx").alias("user_id"), F.col("item_idx").alias("item_id"))
    top = RC.reco_top_k_als(model, users.select(F.col("user_idx").alias("user_id")), seen, 5)
    return top.join(users.withColumnRenamed("user_id", "uid"),
                    F.col("user_id") == F.col("user_idx")) \
              .join(items.withColumnRenamed("item_id", "iid"), F.col("item_id") == F.col("item_idx")) \
              .select(F.col("uid").alias("user_id"), F.col("iid").alias("item_id"), "rank")


def _svd_query(implicit: bool):
    def q(spark, sf):
        train, test = ratings_split(spark, sf)
        tr = train.select("user_id", "item_id", "rating")
        fitted = RC.reco_svd(tr, factors=8, iterations=5)
        pred = RC.reco_svd_predict(fitted, test.select("user_id", "item_id", "rating"),
                                   RC.reco_rating_bounds(tr), implicit_term=implicit, ratings=tr)
        return M.ratings(pred, "rating", "prediction")
    return q


register("reco_svd")(_svd_query(False))
register("reco_svdpp")(_svd_query(True))


@register("reco_nmf")
def q_reco_nmf(spark, sf):
    train, test = ratings_split(spark, sf)
    tr = train.select("user_id", "item_id", "rating")
    model, users, items = RC.reco_nmf(tr, factors=8, iterations=5)
    t = test.select("user_id", "item_id", "rating").join(users, "user_id", "left") \
            .join(items, "item_id", "left").fillna(-1, ["user_idx", "item_idx"])
    pred = model.transform(t).withColumn(
        "prediction", F.coalesce(F.nanvl("prediction", F.lit(None)), F.lit(0.0)))
    return M.ratings(pred, "rating", "prediction")


def _knn_sql(sim: str, k: int, min_k: int, user_based: bool = True) -> str:
    """Neighbourhood predictions of the held-out pairs and of an unknown user."""
    x, y = ("user_id", "item_id") if user_based else ("item_id", "user_id")
    return f"""WITH {_SPLIT_SQL},
r AS (SELECT user_id, item_id, max(rating) AS rating FROM tr GROUP BY user_id, item_id),
asked AS (SELECT DISTINCT user_id, item_id FROM te UNION SELECT DISTINCT -1, item_id FROM te),
s AS (SELECT p.{x} AS a, q.{x} AS b, count(*) AS n, sum(p.rating * q.rating) AS sxy, sum(p.rating * p.rating) AS sxx,
        sum(q.rating * q.rating) AS syy, sum(p.rating) AS sx, sum(q.rating) AS sy,
        sum((p.rating - q.rating) * (p.rating - q.rating)) AS sdd
      FROM r p JOIN r q ON p.{y} = q.{y} WHERE p.{x} IN (SELECT {x} FROM asked) GROUP BY ALL),
sims AS (SELECT a, b, CASE WHEN a = b THEN 1.0 ELSE coalesce({sim}, 0.0) END AS sim FROM s),
c AS (SELECT asked.user_id, asked.item_id, sim, rating,
        row_number() OVER (PARTITION BY asked.user_id, asked.item_id ORDER BY sim DESC, b) AS rank
      FROM asked JOIN r ON r.{y} = asked.{y} JOIN sims ON a = asked.{x} AND b = r.{x}),
e AS (SELECT user_id, item_id, count(*) AS neighbours, sum(sim * rating) / sum(sim) AS p FROM c
      WHERE rank <= {k} AND sim > 0 GROUP BY ALL)
SELECT user_id, item_id, coalesce(neighbours, 0) AS neighbours, round(least(greatest(
    CASE WHEN neighbours >= {min_k} THEN p ELSE (SELECT avg(rating) FROM r) END, (SELECT min(rating) FROM r)),
    (SELECT max(rating) FROM r)), 6) AS prediction
FROM asked LEFT JOIN e USING (user_id, item_id)"""


def _knn(spark, sf, **how):
    from loomkit.operators.reco_knn import reco_knn
    train, test = ratings_split(spark, sf)
    once = train.groupBy("user_id", "item_id").agg(F.max("rating").alias("rating"))
    pairs = test.select("user_id", "item_id").unionByName(
        test.select(F.lit(-1).cast("bigint").alias("user_id"), "item_id"))
    return reco_knn(once, pairs, **how)


@register("reco_knn", _knn_sql("CASE WHEN sxx * syy > 0 THEN sxy / sqrt(sxx * syy) END", 40, 1), digits=6)
def q_reco_knn(spark, sf):
    return _knn(spark, sf)


@register("reco_knn_msd_items", _knn_sql("1 / (sdd / n + 1)", 5, 2, user_based=False), digits=6)
def q_reco_knn_msd_items(spark, sf):
    return _knn(spark, sf, k=5, min_k=2, sim="msd", user_based=False)


@register("reco_knn_pearson", _knn_sql(
    "CASE WHEN (n * sxx - sx * sx) * (n * syy - sy * sy) > 0 "
    "THEN (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) END", 3, 1), digits=6)
def q_reco_knn_pearson(spark, sf):
    return _knn(spark, sf, k=3, sim="pearson")
