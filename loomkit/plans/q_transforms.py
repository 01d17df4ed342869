"""Queries for feature transforms (survey 2.3): fit on the train split, apply
to every row.  The oracle fits on the same hash-split train rows in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomkit.functions.exprs import hash_unit, r6
from loomkit.operators import transforms as TF
from loomkit.plans.registry import register, sql_hash
from loomkit.plans.q_splits import LI_KEY, LI_KEY_SQL, lineitem_keyed
from loomkit.session import load_table

TRAIN_CUT = 0.7


def _train(df, *keys):
    return df.where(hash_unit(42, *keys) < F.lit(TRAIN_CUT))


def _li_train_sql(cols: str = "*") -> str:
    return f"(SELECT {cols} FROM lineitem WHERE {sql_hash(42, LI_KEY_SQL)} < {TRAIN_CUT!r})"


_LI_OUT = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_LI_OUT_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def _li_fit_apply(spark, sf, column, op, params=None, rnd=6):
    li = lineitem_keyed(spark, sf)
    tr = _train(li, *LI_KEY)
    out = TF.fit_transform_one(tr, li, column, op, params, keep=_LI_OUT)
    return out.withColumn(column, r6(column, rnd))


@register("tf_passthrough", f"SELECT {_LI_OUT_SQL}, CAST(l_quantity AS DOUBLE) AS l_quantity FROM lineitem")
def q_tf_passthrough(spark, sf):
    return _li_fit_apply(spark, sf, "l_quantity", "passthrough")


@register("tf_drop", f"SELECT {_LI_OUT_SQL}, l_tax FROM lineitem")
def q_tf_drop(spark, sf):
    from loomkit.plans.features import build_feature_frame
    li = load_table(spark, sf, "lineitem").select(*_LI_OUT, "l_tax", "l_discount")
    cfg = [{"column": "l_tax", "op": "none"}, {"column": "l_discount", "op": "drop"}]
    out = build_feature_frame(li, li, cfg, schema={"l_tax": "numeric", "l_discount": "numeric"},
                              keep=_LI_OUT, assemble=False, short_names=True)
    return out


@register("tf_standard_scale", f"""
WITH s AS (SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(38,10))) AS DOUBLE) / count(*) AS m,
             stddev_pop(l_extendedprice) AS sd FROM {_li_train_sql()})
SELECT {_LI_OUT_SQL}, round((l_extendedprice - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6)
  AS l_extendedprice FROM lineitem, s""")
def q_tf_standard_scale(spark, sf):
    return _li_fit_apply(spark, sf, "l_extendedprice", "standard_scale")


@register("tf_min_max", f"""
WITH s AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM {_li_train_sql()})
SELECT {_LI_OUT_SQL}, round((l_quantity - lo) * (2.0 / CASE WHEN hi = lo THEN 1 ELSE hi - lo END)
  + (-1.0), 6) AS l_quantity FROM lineitem, s""")
def q_tf_min_max(spark, sf):
    return _li_fit_apply(spark, sf, "l_quantity", "min_max", {"feature_range": (-1, 1)})


@register("tf_log1p", f"SELECT {_LI_OUT_SQL}, round(ln(1 + l_extendedprice), 6) AS l_extendedprice FROM lineitem")
def q_tf_log1p(spark, sf):
    return _li_fit_apply(spark, sf, "l_extendedprice", "log")


def _part_onehot(spark, sf, column, params):
    p = load_table(spark, sf, "part")
    tr = _train(p, "p_partkey")
    o = TF.ColumnOp(column, "one_hot", params, key=f"0_one_hot_{column}")
    TF.fit_ops(tr, [o])
    outs = o.outputs()
    arr = F.array(*[e for _, e in outs])
    return p.select("p_partkey",
                    (F.array_position(arr, F.lit(1.0)) - 1).cast("bigint").alias("hot_index"),
                    F.lit(len(outs)).cast("bigint").alias("width"))


@register("tf_one_hot", f"""
WITH c AS (SELECT DISTINCT p_brand FROM part WHERE {sql_hash(42, 'p_partkey')} < {TRAIN_CUT!r}),
i AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS idx FROM c)
SELECT p_partkey, CAST(coalesce(idx, -1) AS BIGINT) AS hot_index,
  CAST((SELECT count(*) FROM c) AS BIGINT) AS width FROM part LEFT JOIN i USING (p_brand)""")
def q_tf_one_hot(spark, sf):
    return _part_onehot(spark, sf, "p_brand", {})


@register("tf_one_hot_min_frequency", f"""
WITH c AS (SELECT p_brand, count(*) AS n FROM part WHERE {sql_hash(42, 'p_partkey')} < {TRAIN_CUT!r}
           GROUP BY p_brand),
f AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS idx FROM c WHERE n >= 60),
w AS (SELECT (SELECT count(*) FROM f) AS nf, (SELECT count(*) FROM c WHERE n < 60) AS nr)
SELECT p_partkey, CAST(CASE WHEN f.idx IS NOT NULL THEN f.idx
    WHEN p_brand IN (SELECT p_brand FROM c WHERE n < 60) THEN nf ELSE -1 END AS BIGINT) AS hot_index,
  CAST(nf + CASE WHEN nr > 0 THEN 1 ELSE 0 END AS BIGINT) AS width
FROM part LEFT JOIN f USING (p_brand), w""")
def q_tf_one_hot_min_frequency(spark, sf):
    return _part_onehot(spark, sf, "p_brand", {"min_frequency": 60})


def _ordinal_sql(table, key, col):
    return f"""
WITH c AS (SELECT DISTINCT {col} FROM {table} WHERE {sql_hash(42, key)} < {TRAIN_CUT!r}),
i AS (SELECT {col}, row_number() OVER (ORDER BY {col}) - 1 AS idx FROM c)
SELECT {key}, CAST(coalesce(idx, -1) AS DOUBLE) AS {col} FROM {table} LEFT JOIN i USING ({col})"""


@register("tf_ordinal", _ordinal_sql("customer", "c_custkey", "c_mktsegment"))
def q_tf_ordinal(spark, sf):
    c = load_table(spark, sf, "customer")
    return TF.fit_transform_one(_train(c, "c_custkey"), c, "c_mktsegment", "ordinal",
                                keep=["c_custkey"])


@register("tf_label", _ordinal_sql("part", "p_partkey", "p_type"))
def q_tf_label(spark, sf):
    p = load_table(spark, sf, "part")
    return TF.fit_transform_one(_train(p, "p_partkey"), p, "p_type", "label", keep=["p_partkey"])


_PARTS_SQL = {"year": "year({c})", "month": "month({c})", "day": "day({c})",
              "dow": "isodow({c}) - 1", "quarter": "quarter({c})", "hour": "hour({c})"}


def _date_sql(table, key, col, hour: bool):
    names = [n for n in _PARTS_SQL if n != "hour" or hour]
    stats = ", ".join(
        f"CAST(sum(CAST({_PARTS_SQL[n].format(c=col)} AS DECIMAL(38,10))) AS DOUBLE) / count(*) AS m_{n}, "
        f"stddev_pop({_PARTS_SQL[n].format(c=col)}) AS s_{n}" for n in names)
    outs = ", ".join(
        f"round(({_PARTS_SQL[n].format(c=col)} - m_{n}) / CASE WHEN s_{n} = 0 THEN 1 ELSE s_{n} END, 6)"
        f" AS {col}_{n}" for n in names)
    return f"""
WITH s AS (SELECT {stats} FROM {table} WHERE {sql_hash(42, key)} < {TRAIN_CUT!r})
SELECT {key}, {outs} FROM {table}, s"""


def _date_query(spark, sf, table, key, col):
    t = load_table(spark, sf, table)
    o = TF.ColumnOp(col, "date_features", {}, key=f"0_date_features_{col}")
    TF.fit_ops(_train(t, key), [o])
    return t.select(key, *[r6(e).alias(n) for n, e in o.outputs()])


@register("tf_date_features", _date_sql("orders", "o_orderkey", "o_orderdate", hour=False))
def q_tf_date_features(spark, sf):
    return _date_query(spark, sf, "orders", "o_orderkey", "o_orderdate")


@register("tf_date_features_hour", _date_sql("events", "event_id", "ts", hour=True))
def q_tf_date_features_hour(spark, sf):
    return _date_query(spark, sf, "events", "event_id", "ts")


_NULL_DISC_SQL = f"""(SELECT {_LI_OUT_SQL}, {LI_KEY_SQL} AS key, nullif(l_discount, 0) AS d FROM lineitem)"""


def _impute_query(spark, sf, op):
    li = lineitem_keyed(spark, sf).withColumn(
        "d", F.when(F.col("l_discount") != 0, F.col("l_discount")))
    out = TF.fit_transform_one(_train(li, *LI_KEY), li, "d", op, keep=_LI_OUT)
    return out.withColumn("d", r6("d"))


@register("tf_impute_mean", f"""
WITH s AS (SELECT CAST(sum(CAST(d AS DECIMAL(38,10))) AS DOUBLE) / count(d) AS v
           FROM {_NULL_DISC_SQL} WHERE {sql_hash(42, 'key')} < {TRAIN_CUT!r})
SELECT {_LI_OUT_SQL}, round(coalesce(d, v), 6) AS d FROM {_NULL_DISC_SQL}, s""")
def q_tf_impute_mean(spark, sf):
    return _impute_query(spark, sf, "impute_mean")


@register("tf_impute_median", f"""
WITH s AS (SELECT median(d) AS v FROM {_NULL_DISC_SQL} WHERE {sql_hash(42, 'key')} < {TRAIN_CUT!r})
SELECT {_LI_OUT_SQL}, round(coalesce(d, v), 6) AS d FROM {_NULL_DISC_SQL}, s""")
def q_tf_impute_median(spark, sf):
    return _impute_query(spark, sf, "impute_median")


@register("tf_impute_mode", f"""
WITH c AS (SELECT d, count(*) AS n FROM {_NULL_DISC_SQL}
           WHERE {sql_hash(42, 'key')} < {TRAIN_CUT!r} AND d IS NOT NULL GROUP BY d),
s AS (SELECT min(d) AS v FROM c WHERE n = (SELECT max(n) FROM c))
SELECT {_LI_OUT_SQL}, round(coalesce(d, v), 6) AS d FROM {_NULL_DISC_SQL}, s""")
def q_tf_impute_mode(spark, sf):
    return _impute_query(spark, sf, "impute_mode")


@register("encode_target", """
WITH c AS (SELECT l_returnflag, CAST(row_number() OVER (ORDER BY l_returnflag) - 1 AS BIGINT) AS label
           FROM (SELECT DISTINCT l_returnflag FROM lineitem))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, label FROM lineitem JOIN c USING (l_returnflag)""")
def q_encode_target(spark, sf):
    from loomkit.operators.profile import target_classes
    li = load_table(spark, sf, "lineitem")
    enc = TF.encode_target(li, "l_returnflag", target_classes(li, "l_returnflag"))
    return enc.select(*_LI_OUT, "label")


@register("decode_label", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_linenumber - 1 BETWEEN 0 AND 2 THEN ['A', 'N', 'R'][l_linenumber]
       ELSE CAST(l_linenumber - 1 AS VARCHAR) END AS label
FROM lineitem""")
def q_decode_label(spark, sf):
    li = load_table(spark, sf, "lineitem")
    return li.select(*_LI_OUT, TF.decode_label(F.col("l_linenumber") - 1, ["A", "N", "R"], True)
                     .alias("label"))


# ---------------------------------------------------------------- whole plans on orders

_ORD_TRAIN = f"(SELECT * FROM orders WHERE {sql_hash(42, 'o_orderkey')} < {TRAIN_CUT!r})"
_STATUS = ["F", "O", "P"]
_PRIORITY = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _safe(n):
    import re
    return '"' + re.sub(r"[^0-9A-Za-z_]", "_", n) + '"'


def _plan_sql(explicit: bool) -> str:
    """The oracle of a whole plan on orders, assembled from the per-op SQL."""
    stats = [f"CAST(sum(CAST(o_totalprice AS DECIMAL(38,10))) AS DOUBLE) / count(*) AS m_tp",
             "stddev_pop(o_totalprice) AS s_tp"]
    for n, e in _PARTS_SQL.items():
        if n == "hour":
            continue
        e = e.format(c="o_orderdate")
        stats.append(f"CAST(sum(CAST({e} AS DECIMAL(38,10))) AS DOUBLE) / count(*) AS m_{n}, "
                     f"stddev_pop({e}) AS s_{n}")
    outs = []
    if explicit:
        outs.append("round((o_totalprice - m_tp) / CASE WHEN s_tp = 0 THEN 1 ELSE s_tp END, 6) AS "
                    + _safe("0_standard_scale_o_totalprice__o_totalprice"))
        outs.append("round(ln(1 + o_totalprice), 6) AS " + _safe("1_log_o_totalprice__o_totalprice"))
        outs.append("round(CAST(CASE o_orderpriority " + " ".join(
            f"WHEN '{v}' THEN {i}" for i, v in enumerate(_PRIORITY)) + " ELSE -1 END AS DOUBLE), 6) AS "
            + _safe("4_ordinal_o_orderpriority__o_orderpriority"))
    else:
        for c in ("o_orderkey", "o_custkey", "o_totalprice"):
            outs.append(f"round(CAST({c} AS DOUBLE), 6) AS " + _safe(f"auto_passthrough__{c}"))
    cats = [("o_orderstatus", _STATUS)] + ([] if explicit else [("o_orderpriority", _PRIORITY)])
    for c, vals in cats:
        for v in vals:
            outs.append(f"CASE WHEN {c} = '{v}' THEN 1.0 ELSE 0.0 END AS "
                        + _safe(f"auto_onehot__{c}_{v}"))
    for n, e in _PARTS_SQL.items():
        if n == "hour":
            continue
        e = e.format(c="o_orderdate")
        outs.append(f"round(({e} - m_{n}) / CASE WHEN s_{n} = 0 THEN 1 ELSE s_{n} END, 6) AS "
                    + _safe(f"auto_datefeat_o_orderdate__o_orderdate_{n}"))
    return (f"WITH s AS (SELECT {', '.join(stats)} FROM {_ORD_TRAIN}) "
            f"SELECT o_orderkey AS id, {', '.join(outs)} FROM orders, s")


PLAN_CONFIG = [
    {"column": "o_totalprice", "op": "standard_scale"},
    {"column": "o_totalprice", "op": "log"},
    {"column": "o_orderkey", "op": "drop"},
    {"column": "o_custkey", "op": "drop"},
    {"column": "o_orderpriority", "op": "ordinal"},
]


def _plan_query(spark, sf, config):
    from loomkit.operators.profile import coarse_schema_dict
    from loomkit.plans.features import build_feature_pipeline
    o = load_table(spark, sf, "orders")
    train = _train(o, "o_orderkey")
    schema = coarse_schema_dict(train)
    model = build_feature_pipeline(train, config, schema)
    out = model._transform(o.withColumn("id", F.col("o_orderkey")), keep=["id"], assemble=False)
    return out.select("id", *[r6(c).alias(c) for c in out.columns if c != "id"])


@register("build_feature_pipeline", _plan_sql(explicit=True))
def q_build_feature_pipeline(spark, sf):
    return _plan_query(spark, sf, PLAN_CONFIG)


@register("tf_defaults", _plan_sql(explicit=False))
def q_tf_defaults(spark, sf):
    return _plan_query(spark, sf, [])


# ---------------------------------------------------------------- categories of any number

def _codes(spark, sf, op, params):
    """Comments with gaps (every seventh row's is missing) as categories."""
    o = load_table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("c"), F.col("o_custkey"))).alias("who"))
    return TF.ColumnOp("who", op, params, key=f"0_{op}_who"), _train(o, "o_orderkey"), o


_WHO_SQL = f"""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN 'c' || o_custkey END AS who FROM orders),
n AS (SELECT who, count(*) AS n FROM o WHERE {sql_hash(42, 'o_orderkey')} < {TRAIN_CUT!r} GROUP BY who),
i AS (SELECT who, row_number() OVER (ORDER BY who NULLS LAST) - 1 AS code FROM n)"""


@register("tf_one_hot_sparse", _WHO_SQL + """
SELECT o_orderkey, CAST((SELECT count(*) FROM n) AS BIGINT) AS width, CAST(coalesce(code, -1) AS BIGINT) AS hot_index
FROM o LEFT JOIN i ON o.who IS NOT DISTINCT FROM i.who""")
def q_tf_one_hot_sparse(spark, sf):
    op, train, o = _codes(spark, sf, "one_hot", {"sparse": True})
    TF.fit_ops(train, [op])
    # the sparse parts: an array per row would be as wide as there are categories
    out = TF.apply_ops(o, [op], keep=["o_orderkey"]).withColumn("v", F.unwrap_udt("who_onehot"))
    hot = F.element_at("v.indices", F.nullif(F.array_position("v.values", F.lit(1.0)), F.lit(0)).cast("int"))
    return out.select("o_orderkey", F.col("v.size").cast("bigint").alias("width"),
                      F.coalesce(hot, F.lit(-1)).cast("bigint").alias("hot_index"))


@register("tf_ordinal_large", _WHO_SQL + """
SELECT o_orderkey, CASE WHEN o.who IS NULL THEN -2.0 ELSE CAST(coalesce(code, -1) AS DOUBLE) END AS who
FROM o LEFT JOIN i ON o.who IS NOT DISTINCT FROM i.who""")
def q_tf_ordinal_large(spark, sf):
    op, train, o = _codes(spark, sf, "ordinal", {"sparse": True, "encoded_missing_value": -2})
    TF.fit_ops(train, [op])
    return TF.apply_ops(o, [op], keep=["o_orderkey"])
