"""Queries for splits and sampling (survey 2.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomkit.operators import splits as S
from loomkit.plans.registry import register, sql_hash
from loomkit.session import load_table

# lineitem has no single-column key; these five columns are unique at every scale
LI_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_price_cents"]
LI_KEY_SQL = ("concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
              "CAST(round(l_extendedprice * 100) AS BIGINT))")


def lineitem_keyed(spark, sf):
    li = load_table(spark, sf, "lineitem")
    return li.withColumn("l_price_cents", F.round(F.col("l_extendedprice") * 100).cast("bigint"))


@register("split_three_way", f"""
SELECT o_orderkey, CASE WHEN u < {0.7!r} THEN 'train' WHEN u < {0.7 + 0.15!r} THEN 'val'
  ELSE 'test' END AS split
FROM (SELECT o_orderkey, {sql_hash(42, 'o_orderkey')} AS u FROM orders)""")
def q_split_three_way(spark, sf):
    o = load_table(spark, sf, "orders").select("o_orderkey")
    return S.split_three_way(o, ["o_orderkey"], 0.7, 0.15, 0.15, seed=42)


@register("split_stratified", f"""
WITH k AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag,
             {LI_KEY_SQL} AS key FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY {sql_hash(42, 'key')}, key) - 1 AS p,
             count(*) OVER (PARTITION BY l_returnflag) AS n FROM k)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag,
  CASE WHEN p < n * {0.7!r} THEN 'train' WHEN p < n * {0.7 + 0.15!r} THEN 'val' ELSE 'test' END AS split
FROM r""")
def q_split_stratified(spark, sf):
    li = lineitem_keyed(spark, sf)
    out = S.split_stratified(li, "l_returnflag", LI_KEY, 0.7, 0.15, 0.15, seed=42)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                      "l_returnflag", "split")


@register("split_holdout", f"""
SELECT c_custkey, CASE WHEN {sql_hash(7, 'c_custkey')} < {1.0 - 0.2!r} THEN 'train' ELSE 'val' END
  AS split FROM customer""")
def q_split_holdout(spark, sf):
    c = load_table(spark, sf, "customer").select("c_custkey")
    return S.split_holdout(c, ["c_custkey"], 0.2, seed=7)


@register("split_temporal", """
SELECT event_id, event_type, ts,
  CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 24
       THEN 'val' ELSE 'train' END AS split
FROM events""")
def q_split_temporal(spark, sf):
    ev = load_table(spark, sf, "events").select("event_id", "event_type", "ts")
    return S.split_temporal(ev, ["event_type"], ["ts", "event_id"], 24)


@register("split_last_interaction", """
SELECT event_id, user_id,
  CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
       THEN 'test' ELSE 'train' END AS split
FROM events""")
def q_split_last_interaction(spark, sf):
    ev = load_table(spark, sf, "events").select("event_id", "user_id", "ts")
    return S.split_last_interaction(ev, "user_id", ["ts", "event_id"]).drop("ts")


@register("split_ratings_random", f"""
SELECT o_orderkey, CASE WHEN {sql_hash(42, 'o_orderkey')} < {1.0 - 0.2!r} THEN 'train'
  ELSE 'test' END AS split FROM orders""")
def q_split_ratings_random(spark, sf):
    o = load_table(spark, sf, "orders").select("o_orderkey")
    return S.split_ratings_random(o, ["o_orderkey"], 0.2, seed=42)


@register("sample_head_capped", f"""
SELECT o_orderkey, o_custkey FROM orders
ORDER BY {sql_hash(42, 'o_orderkey')}, o_orderkey LIMIT 200""")
def q_sample_head_capped(spark, sf):
    o = load_table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return S.sample_head_capped(o, ["o_orderkey"], 200, seed=42)
