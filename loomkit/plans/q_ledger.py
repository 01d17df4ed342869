"""Queries for run / metric / registry ledgers (survey 2.12) on the driver tables.

Mapping (see FIXTURES.md part C): owner chain lineitem -> orders -> customer
(owner = c_nationkey); metric points from lineitem (run l_orderkey, name
l_returnflag, step l_linenumber, value l_quantity); aliases from orders (model
o_custkey, alias o_orderpriority, version o_orderkey, assigned_at o_orderdate).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomkit.functions.exprs import with_scalars

from loomkit.functions.exprs import r6, slugify
from loomkit.operators import ledger as L
from loomkit.plans.registry import register
from loomkit.session import load_table

OWNER = 7


def _t(spark, sf, name):
    return load_table(spark, sf, name)


@register("scope_by_owner", f"""
SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_nationkey = {OWNER}""")
def q_scope_by_owner(spark, sf):
    c = _t(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    return L.scope_by_owner(c, "c_nationkey", OWNER)


@register("scope_by_chain", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey
                     WHERE c_nationkey = {OWNER})""")
def q_scope_by_chain(spark, sf):
    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                          "l_suppkey", "l_quantity")
    return L.scope_by_chain(li, _t(spark, sf, "orders"), _t(spark, sf, "customer"),
                            "l_orderkey", "o_orderkey", "o_custkey", "c_custkey",
                            "c_nationkey", OWNER)


@register("list_page", """
SELECT o_orderkey, o_orderdate, o_totalprice,
  (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total
FROM orders WHERE o_orderstatus = 'F'
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 100""")
def q_list_page(spark, sf):
    o = _t(spark, sf, "orders").where(F.col("o_orderstatus") == "F") \
        .select("o_orderkey", "o_orderdate", "o_totalprice")
    return L.list_page(o, [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()],
                       page=3, page_size=50)


@register("find_by_tag", """
SELECT event_id, user_id FROM events WHERE json_extract_string(props, '$.k') = '69'""")
def q_find_by_tag(spark, sf):
    ev = _t(spark, sf, "events").select(
        "event_id", "user_id", F.from_json("props", "map<string,string>").alias("tags"))
    return L.find_by_tag(ev, "tags", "k", "69").select("event_id", "user_id")


_STATUS_SQL = "CASE o_orderstatus WHEN 'F' THEN 'FINISHED' WHEN 'O' THEN 'RUNNING' ELSE 'Pending' END"


def _tracking_status():
    return (F.when(F.col("o_orderstatus") == "F", "FINISHED")
             .when(F.col("o_orderstatus") == "O", "RUNNING").otherwise("Pending"))


@register("run_status_map", f"""
SELECT o_orderkey, CASE {_STATUS_SQL} WHEN 'SCHEDULED' THEN 'queued' WHEN 'RUNNING' THEN 'running'
  WHEN 'FINISHED' THEN 'succeeded' WHEN 'FAILED' THEN 'failed' WHEN 'KILLED' THEN 'cancelled'
  ELSE lower({_STATUS_SQL}) END AS status FROM orders""")
def q_run_status_map(spark, sf):
    o = _t(spark, sf, "orders")
    return o.select("o_orderkey", L.run_status_map(_tracking_status()).alias("status"))


def _points(spark, sf):
    li = _t(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("name"),
                     F.col("l_linenumber").alias("step"), F.col("l_quantity").alias("value"),
                     "l_partkey", "l_suppkey", "l_extendedprice")


_POINTS_SQL = """(SELECT l_orderkey AS run_id, l_returnflag AS name, l_linenumber AS step,
  l_quantity AS value, l_partkey, l_suppkey, l_extendedprice FROM lineitem)"""
_ORDER = ["step", "l_partkey", "l_suppkey", "l_extendedprice"]


@register("metric_history", f"""
SELECT run_id, name, step, value FROM {_POINTS_SQL} p
WHERE run_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def q_metric_history(spark, sf):
    runs = _t(spark, sf, "orders").where(F.col("o_orderstatus") == "F") \
        .select(F.col("o_orderkey").alias("run_id"))
    return L.metric_history(_points(spark, sf), runs, "run_id").select(
        "run_id", "name", "step", "value")


@register("metric_latest", f"""
SELECT run_id, name, value FROM (SELECT *, row_number() OVER (PARTITION BY run_id, name
  ORDER BY step DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn
  FROM {_POINTS_SQL}) WHERE rn = 1""")
def q_metric_latest(spark, sf):
    return L.metric_latest(_points(spark, sf), ["run_id", "name"], _ORDER, "value")


@register("metric_pivot", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY run_id, step, name
  ORDER BY step DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn
  FROM {_POINTS_SQL})
SELECT run_id, step, max(CASE WHEN name = 'A' THEN value END) AS "A",
  max(CASE WHEN name = 'N' THEN value END) AS "N", max(CASE WHEN name = 'R' THEN value END) AS "R"
FROM r WHERE rn = 1 GROUP BY run_id, step""")
def q_metric_pivot(spark, sf):
    return L.metric_pivot(_points(spark, sf), ["run_id", "step"], "name", ["A", "N", "R"],
                          _ORDER, "value")


@register("metric_delta", """
SELECT o_orderkey, round(d, 6) AS delta,
  CASE WHEN d IS NULL THEN NULL WHEN abs(d) < 0.0001 THEN 'flat'
       WHEN NOT (d > 0) THEN 'good' ELSE 'bad' END AS verdict
FROM (SELECT o_orderkey, CASE WHEN c_acctbal = 0 THEN NULL
        ELSE (o_totalprice - c_acctbal) / abs(c_acctbal) END AS d
      FROM orders JOIN customer ON o_custkey = c_custkey)""")
def q_metric_delta(spark, sf):
    o = _t(spark, sf, "orders").join(_t(spark, sf, "customer"),
                                     F.col("o_custkey") == F.col("c_custkey"))
    delta, verdict = L.metric_delta(F.col("o_totalprice"), F.col("c_acctbal"), invert=True)
    return o.select("o_orderkey", r6(delta).alias("delta"), verdict.alias("verdict"))


@register("version_lineage", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderdate, p_name, s_name
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
LEFT JOIN (SELECT * FROM part WHERE p_size <= 25) p ON l_partkey = p_partkey
LEFT JOIN supplier ON l_suppkey = s_suppkey""")
def q_version_lineage(spark, sf):
    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    o = _t(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    p = _t(spark, sf, "part").where(F.col("p_size") <= 25).select("p_partkey", "p_name")
    s = _t(spark, sf, "supplier").select("s_suppkey", "s_name")
    return L.version_lineage(li, [(o, "o_orderkey", "l_orderkey"), (p, "p_partkey", "l_partkey"),
                                  (s, "s_suppkey", "l_suppkey")])


def _assignments(spark, sf):
    o = _t(spark, sf, "orders")
    return o.select(F.col("o_custkey").alias("model"), F.col("o_orderpriority").alias("alias"),
                    F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("assigned_at"))


_RESOLVED_SQL = """(SELECT model, alias, version, assigned_at FROM (
  SELECT o_custkey AS model, o_orderpriority AS alias, o_orderkey AS version,
    o_orderdate AS assigned_at, row_number() OVER (PARTITION BY o_custkey, o_orderpriority
    ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1)"""


@register("alias_resolve", f"SELECT * FROM {_RESOLVED_SQL}")
def q_alias_resolve(spark, sf):
    return L.alias_resolve(_assignments(spark, sf), "model", "alias", "version", "assigned_at")


# priorities stand for alias names
_STAGE_NAMES = {"1-URGENT": "production", "2-HIGH": "staging", "3-MEDIUM": "archived"}
_STAGE_NAMES_SQL = ("CASE alias WHEN '1-URGENT' THEN 'production' WHEN '2-HIGH' THEN 'staging' "
                    "WHEN '3-MEDIUM' THEN 'archived' ELSE alias END")


def _named_aliases(spark, sf):
    res = L.alias_resolve(_assignments(spark, sf), "model", "alias", "version", "assigned_at")
    return L.rename_cascade(res, "alias", _STAGE_NAMES)


@register("alias_to_stage", f"""
SELECT model, version, CASE WHEN bool_or(a = 'production') THEN 'production'
  WHEN bool_or(a = 'staging') THEN 'staging' WHEN bool_or(a = 'archived') THEN 'archived'
  ELSE 'none' END AS stage,
  string_agg(a, ',' ORDER BY a) AS aliases
FROM (SELECT model, version, {_STAGE_NAMES_SQL} AS a FROM {_RESOLVED_SQL}) GROUP BY model, version""")
def q_alias_to_stage(spark, sf):
    named = _named_aliases(spark, sf)
    per = named.groupBy("model", "version").agg(F.array_sort(F.collect_set("alias")).alias("arr"))
    return per.select("model", "version", L.alias_to_stage(F.col("arr")).alias("stage"),
                      F.array_join("arr", ",").alias("aliases"))


_EVENT_STAGE_SQL = ("CASE version % 5 WHEN 0 THEN 'archived' WHEN 1 THEN 'none' "
                    "WHEN 2 THEN 'production' END")


@register("alias_promote", f"""
WITH a AS (SELECT model, {_STAGE_NAMES_SQL} AS alias, version FROM {_RESOLVED_SQL}),
ev AS (SELECT DISTINCT model, version, {_EVENT_STAGE_SQL} AS stage FROM a
       WHERE {_EVENT_STAGE_SQL} IS NOT NULL),
sets AS (SELECT model, stage AS alias, max(version) AS version FROM ev WHERE stage <> 'none'
         GROUP BY model, stage),
kept AS (SELECT a.* FROM a
  WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.model = a.model AND ev.version = a.version
                    AND ev.stage IN ('archived', 'none'))
    AND NOT EXISTS (SELECT 1 FROM sets WHERE sets.model = a.model AND sets.alias = a.alias))
SELECT model, alias, version FROM kept UNION ALL SELECT model, alias, version FROM sets""")
def q_alias_promote(spark, sf):
    named = _named_aliases(spark, sf).select("model", "alias", "version")
    v = F.col("version") % 5
    stage = F.when(v == 0, "archived").when(v == 1, "none").when(v == 2, "production")
    events = named.select("model", "version", stage.alias("stage")) \
                  .where(F.col("stage").isNotNull()).distinct()
    return L.alias_promote(named, events, "model", "alias", "version")


@register("visible_models", """
SELECT c_custkey, c_name FROM customer WHERE c_custkey IN
  (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def q_visible_models(spark, sf):
    c = _t(spark, sf, "customer").select("c_custkey", "c_name")
    v = _t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    return L.visible_models(c, v, "c_custkey", "o_orderpriority", "1-URGENT")


@register("versions_desc", """
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey
  ORDER BY o_orderkey DESC) AS position FROM orders""")
def q_versions_desc(spark, sf):
    o = _t(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return L.versions_desc(o, "o_custkey", "o_orderkey").withColumn(
        "position", F.col("position").cast("bigint"))


@register("delete_blockers", """
SELECT c_custkey, coalesce(n, 0) AS n_children, coalesce(n, 0) > 0 AS blocked
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders
  WHERE o_orderdate >= TIMESTAMP '2001-01-01' GROUP BY o_custkey) ON o_custkey = c_custkey""")
def q_delete_blockers(spark, sf):
    c = _t(spark, sf, "customer")
    o = _t(spark, sf, "orders").where(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz"))
    return L.delete_blockers(c, o, "c_custkey", "o_custkey")


@register("orphan_models", """
SELECT p_partkey FROM part WHERE p_partkey NOT IN
  (SELECT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-06-01')""")
def q_orphan_models(spark, sf):
    p = _t(spark, sf, "part").select("p_partkey")
    li = _t(spark, sf, "lineitem").where(
        F.col("l_shipdate") >= F.lit("2001-06-01").cast("timestamp_ntz")) \
        .select(F.col("l_partkey").alias("p_partkey"))
    return L.orphan_models(p, li, "p_partkey")


@register("upsert_by_key", """
WITH o AS (SELECT p_partkey, p_name, p_retailprice FROM part),
n AS (SELECT CASE WHEN p_partkey % 100 = 0 THEN p_partkey + (SELECT max(p_partkey) + 1 FROM part)
        ELSE p_partkey END AS p_partkey, p_name,
        CASE WHEN p_partkey % 10 = 0 THEN p_retailprice + 1 ELSE p_retailprice END AS p_retailprice
      FROM part)
SELECT coalesce(n.p_partkey, o.p_partkey) AS p_partkey,
  CASE WHEN n.p_partkey IS NOT NULL THEN n.p_name ELSE o.p_name END AS p_name,
  CASE WHEN n.p_partkey IS NOT NULL THEN n.p_retailprice ELSE o.p_retailprice END AS p_retailprice,
  CASE WHEN n.p_partkey IS NOT NULL AND o.p_partkey IS NULL THEN 'created'
       WHEN n.p_partkey IS NOT NULL AND (o.p_name IS DISTINCT FROM n.p_name
            OR o.p_retailprice IS DISTINCT FROM n.p_retailprice) THEN 'updated'
       WHEN n.p_partkey IS NOT NULL THEN 'unchanged' ELSE 'kept' END AS action
FROM o FULL OUTER JOIN n ON o.p_partkey = n.p_partkey""")
def q_upsert_by_key(spark, sf):
    p = _t(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice")
    mx = p.agg((F.max("p_partkey") + 1).alias("_shift"))
    new = with_scalars(p, mx).select(
        F.when(F.col("p_partkey") % 100 == 0, F.col("p_partkey") + F.col("_shift"))
         .otherwise(F.col("p_partkey")).alias("p_partkey"), "p_name",
        F.when(F.col("p_partkey") % 10 == 0, F.col("p_retailprice") + 1)
         .otherwise(F.col("p_retailprice")).alias("p_retailprice"))
    merged, _counts = L.upsert_by_key(p, new, "p_partkey")
    return merged


_RENAME = {"NATION_0": "ALGERIA", "NATION_1": "ARGENTINA", "NATION_2": "BRAZIL"}


@register("rename_cascade", """
SELECT c_custkey, CASE n_name WHEN 'NATION_0' THEN 'ALGERIA' WHEN 'NATION_1' THEN 'ARGENTINA'
  WHEN 'NATION_2' THEN 'BRAZIL' ELSE n_name END AS n_name
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def q_rename_cascade(spark, sf):
    c = _t(spark, sf, "customer").join(
        _t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")) \
        .select("c_custkey", "n_name")
    return L.rename_cascade(c, "n_name", _RENAME)


@register("file_inventory", """
WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path FROM pages),
b AS (SELECT page_id, path, regexp_extract(path, '([^/]*)$', 1) AS name FROM p),
k AS (SELECT *, CASE
  WHEN lower(name) LIKE '%.pkl' OR lower(name) LIKE '%.joblib' THEN 'model'
  WHEN lower(name) LIKE '%.png' AND lower(name) LIKE '%shap%' THEN 'shap'
  WHEN lower(name) LIKE '%.png' AND lower(name) LIKE '%bias%' THEN 'bias'
  WHEN lower(name) LIKE '%.png' THEN 'image'
  WHEN lower(name) = 'selected_hyperparams.json' THEN 'selected_hyperparams'
  WHEN lower(name) = 'input_schema.json' THEN 'input_schema'
  WHEN lower(name) LIKE '%.json' THEN 'json'
  WHEN lower(name) LIKE '%.csv' THEN 'csv'
  WHEN lower(name) LIKE '%.log' OR lower(name) LIKE '%.jsonl' THEN 'logs'
  ELSE 'file' END AS kind FROM b)
SELECT page_id, path, name, kind, CASE WHEN kind = 'model' THEN 'application/octet-stream'
  WHEN kind IN ('shap', 'bias', 'image') THEN 'image/png'
  WHEN kind IN ('selected_hyperparams', 'input_schema', 'json') THEN 'application/json'
  WHEN kind = 'csv' THEN 'text/csv' WHEN kind = 'logs' THEN 'text/plain' END AS content_type
FROM k""")
def q_file_inventory(spark, sf):
    p = _t(spark, sf, "pages").select("page_id",
                                      F.regexp_replace("url", r"[?#].*$", "").alias("path"))
    return L.file_inventory(p, "path")


@register("hyperparams_fallback", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'report' ELSE 'legacy' END AS source,
  CASE WHEN o_orderstatus = 'F' THEN '{"total": ' || CAST(o_orderkey * 3 AS VARCHAR) || '}'
       ELSE '{"priority": "' || o_orderpriority || '"}' END AS hyperparameters
FROM orders""")
def q_hyperparams_fallback(spark, sf):
    o = _t(spark, sf, "orders")
    runs = o.select("o_orderkey", F.concat(F.lit('{"priority": "'), F.col("o_orderpriority"),
                                           F.lit('"}')).alias("params"))
    reports = o.where(F.col("o_orderstatus") == "F").select(
        "o_orderkey", F.concat(F.lit('{"total": '), (F.col("o_orderkey") * 3).cast("string"),
                               F.lit("}")).alias("report"))
    return L.hyperparams_fallback(runs, reports, "o_orderkey", "report", "params")


@register("dashboard_counts", """
WITH c AS (SELECT o_orderpriority, count(*) AS n_total,
             sum(CASE WHEN o_orderstatus IN ('O', 'P') THEN 1 ELSE 0 END) AS n_active
           FROM orders GROUP BY o_orderpriority),
r AS (SELECT o_orderpriority, o_orderkey, o_orderdate, row_number() OVER (
        PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank FROM orders)
SELECT r.o_orderpriority, o_orderkey, o_orderdate, rank, n_total, CAST(n_active AS BIGINT) AS n_active
FROM r JOIN c USING (o_orderpriority) WHERE rank <= 5""")
def q_dashboard_counts(spark, sf):
    o = _t(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_orderdate",
                                       "o_orderstatus")
    counts, recent = L.dashboard_counts(o, "o_orderpriority", "o_orderstatus", ["O", "P"],
                                        ["o_orderdate", "o_orderkey"], 5)
    return recent.drop("o_orderstatus").join(counts, "o_orderpriority") \
                 .withColumn("rank", F.col("rank").cast("bigint"))


@register("scalar_helpers", r"""
SELECT p_partkey,
  CASE WHEN s = '' THEN 'model' ELSE s END AS slug,
  left(md5(CAST(p_partkey AS VARCHAR)), 8) AS short_id,
  TIMESTAMP '1970-01-01 00:00:00' + to_milliseconds(1700000000000 + p_partkey * 1000) AS created_at,
  round(ln(1 + p_retailprice), 6) AS log_price
FROM (SELECT p_partkey, p_retailprice, regexp_replace(regexp_replace(lower(trim(p_name || ' / ' || p_brand)),
  '[^\p{L}\p{N}_-]', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM part)""")
def q_scalar_helpers(spark, sf):
    p = _t(spark, sf, "part")
    return p.select(
        "p_partkey",
        slugify(F.concat_ws(" / ", "p_name", "p_brand")).alias("slug"),
        F.left(F.md5(F.col("p_partkey").cast("string")), F.lit(8)).alias("short_id"),
        F.expr("timestampadd(MILLISECOND, 1700000000000 + p_partkey * 1000, "
               "TIMESTAMP_NTZ '1970-01-01 00:00:00')").alias("created_at"),
        r6(F.log1p("p_retailprice")).alias("log_price"))
