"""Queries for profiling, type inference and validation (survey 2.2)."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from loomkit.operators import profile as P
from loomkit.plans import registry

from loomkit.session import load_table

# operators do not round; the comparison with the oracle does
register = functools.partial(registry.register, digits={"null_fraction": 8})

# lineitem columns and their Spark type names (for the oracle's literals)
LINEITEM = [
    ("l_orderkey", "bigint", True), ("l_partkey", "bigint", True),
    ("l_suppkey", "bigint", True), ("l_linenumber", "int", True),
    ("l_quantity", "double", True), ("l_extendedprice", "double", True),
    ("l_discount", "double", True), ("l_tax", "double", True),
    ("l_returnflag", "string", False), ("l_linestatus", "string", False),
    ("l_shipdate", "timestamp_ntz", False),
]
DATETIME_COLS = {"l_shipdate"}


def _per_column_sql(table: str, cols, with_stats: bool = True) -> str:
    parts = []
    for i, (c, t, num) in enumerate(cols):
        if num:
            stats = (f"round(CAST(sum(CAST({c} AS DECIMAL(38,6))) AS DOUBLE) / count({c}), 6) AS mean, "
                     f"round(stddev_samp(CAST({c} AS DOUBLE)), 6) AS std, "
                     f"round(min(CAST({c} AS DOUBLE)), 6) AS min, "
                     f"round(max(CAST({c} AS DOUBLE)), 6) AS max")
        else:
            stats = ("CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, "
                     "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max")
        kind = ("numeric" if num else "datetime" if c in DATETIME_COLS else "other")
        parts.append(
            f"SELECT '{c}' AS column_name, {i} AS ordinal, '{t}' AS inferred_type, "
            f"'{kind}' AS kind, count(*) AS n_rows, count({c}) AS count, {stats}, "
            f"count(DISTINCT {c}) AS unique_count FROM {table}")
    return " UNION ALL ".join(parts)


def _profile_sql(table: str, cols) -> str:
    return f"""
WITH s AS ({_per_column_sql(table, cols)}),
t AS (
  SELECT *, round((n_rows - count) * 100.0::DOUBLE / n_rows, 6) AS missing_pct,
    CASE WHEN kind <> 'other' THEN kind
         WHEN unique_count > 0 AND unique_count <= greatest(20, floor(n_rows * 0.05::DOUBLE))
         THEN 'categorical' ELSE 'text' END AS semantic_type
  FROM s)
SELECT column_name, ordinal, inferred_type, semantic_type, count, mean, std, min, max,
  missing_pct, unique_count, round(missing_pct / 100.0::DOUBLE, 8) AS null_fraction,
  CASE semantic_type WHEN 'numeric' THEN 'standardize' WHEN 'categorical' THEN 'one-hot'
    WHEN 'boolean' THEN 'keep' WHEN 'datetime' THEN 'keep' ELSE 'drop' END
    AS suggested_transform,
  concat_ws(',', 'supervised',
    CASE WHEN semantic_type IN ('numeric', 'categorical', 'boolean') THEN 'clustering' END,
    CASE WHEN semantic_type IN ('numeric', 'datetime') THEN 'forecasting' END,
    CASE WHEN semantic_type IN ('numeric', 'categorical', 'boolean') THEN 'recommender' END)
    AS suitable_for
FROM t"""


@register("profile_dataset", _profile_sql("lineitem", LINEITEM))
def q_profile_dataset(spark, sf):
    return P.profile_dataset(load_table(spark, sf, "lineitem"))


@register("profile_shape", "SELECT count(*) AS n_rows, CAST(11 AS BIGINT) AS n_cols FROM lineitem")
def q_profile_shape(spark, sf):
    return P.profile_shape(load_table(spark, sf, "lineitem"))


# Missing values derived inside the query: zero discounts become NULL, NaN
# prices on every 7th order key, NULL flags on every 11th.
_MISSING_SQL_SRC = """(SELECT l_orderkey, nullif(l_discount, 0) AS l_discount,
   CASE WHEN l_orderkey % 7 = 0 THEN CAST('NaN' AS DOUBLE) ELSE l_extendedprice END AS l_extendedprice,
   CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag
 FROM lineitem)"""


def _missing_frame(spark, sf):
    li = load_table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey",
        F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("l_discount"),
        F.when(F.col("l_orderkey") % 7 == 0, F.lit(float("nan")))
         .otherwise(F.col("l_extendedprice")).alias("l_extendedprice"),
        F.when(F.col("l_orderkey") % 11 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("l_returnflag")).alias("l_returnflag"))


_MISSING_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(count(*) FILTER (WHERE {c} IS NULL {extra}) * 100.0::DOUBLE"
    f" / count(*), 6) AS missing_pct FROM {_MISSING_SQL_SRC}"
    for c, extra in [("l_orderkey", ""), ("l_discount", ""),
                     ("l_extendedprice", "OR isnan(l_extendedprice)"), ("l_returnflag", "")])


@register("profile_missing", _MISSING_SQL)
def q_profile_missing(spark, sf):
    return P.profile_missing(_missing_frame(spark, sf))


@register("profile_unique", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS unique_count FROM "
    f"(SELECT l_orderkey, l_discount, CASE WHEN isnan(l_extendedprice) THEN NULL ELSE "
    f"l_extendedprice END AS l_extendedprice, l_returnflag FROM {_MISSING_SQL_SRC})"
    for c in ["l_orderkey", "l_discount", "l_extendedprice", "l_returnflag"]))
def q_profile_unique(spark, sf):
    return P.profile_unique(_missing_frame(spark, sf))


@register("profile_numeric_stats", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS count, "
    f"round(CAST(sum(CAST({c} AS DECIMAL(38,6))) AS DOUBLE) / count({c}), 6) AS mean, "
    f"round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, round(max({c}), 6) AS max "
    f"FROM (SELECT l_orderkey::DOUBLE AS l_orderkey, l_discount, CASE WHEN isnan(l_extendedprice) "
    f"THEN NULL ELSE l_extendedprice END AS l_extendedprice FROM {_MISSING_SQL_SRC})"
    for c in ["l_orderkey", "l_discount", "l_extendedprice"]))
def q_profile_numeric_stats(spark, sf):
    return P.profile_numeric_stats(_missing_frame(spark, sf))


_DOC_COLS = [("doc_id", True, "numeric"), ("text", False, "other"), ("lang", False, "other"),
             ("source", False, "other"), ("n_chars", True, "numeric")]


@register("infer_semantic", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, " + (
        f"'{k}'" if k != "other" else
        f"CASE WHEN count(DISTINCT {c}) > 0 AND count(DISTINCT {c}) <= "
        f"greatest(20, floor(count(*) * 0.05::DOUBLE)) THEN 'categorical' ELSE 'text' END")
    + " AS semantic_type" + ("" if k != "other" else " FROM documents")
    for c, _, k in _DOC_COLS))
def q_infer_semantic(spark, sf):
    return P.infer_semantic(load_table(spark, sf, "documents"))


@register("coarse_schema", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, " + (
        f"'{k}'" if k != "other" else
        f"CASE WHEN count(DISTINCT {c}) <= greatest(50, floor(sqrt(count(*)))) "
        f"THEN 'categorical' ELSE 'text' END")
    + " AS coarse_type" + ("" if k != "other" else " FROM documents")
    for c, _, k in _DOC_COLS))
def q_coarse_schema(spark, sf):
    return P.coarse_schema(load_table(spark, sf, "documents"))


# shipdate as text, every 7th order key corrupted; parse under 'datetime'
@register("coerce_semantic", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  try_strptime(s, '%Y-%m-%d %H:%M:%S') AS l_shipdate
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_orderkey % 7 = 0 THEN 'not a date ' || CAST(l_orderkey AS VARCHAR)
       ELSE strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') END AS s FROM lineitem)""")
def q_coerce_semantic(spark, sf):
    li = load_table(spark, sf, "lineitem")
    raw = li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(F.col("l_orderkey") % 7 == 0,
               F.concat(F.lit("not a date "), F.col("l_orderkey").cast("string")))
         .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")).alias("l_shipdate"))
    out = P.coerce_semantic(raw, {"l_shipdate": "datetime"})
    return out.withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp_ntz"))


@register("infer_task", """
SELECT 'l_quantity' AS target, count(DISTINCT l_quantity) AS n_unique,
  CASE WHEN count(DISTINCT l_quantity) > 20 THEN 'regression' ELSE 'classification' END AS task,
  CASE WHEN count(DISTINCT l_quantity) > 20 THEN 'regression'
       WHEN count(DISTINCT l_quantity) <= 2 THEN 'binary_classification'
       ELSE 'multiclass_classification' END AS task_3way FROM lineitem
UNION ALL
SELECT 'l_linenumber', count(DISTINCT l_linenumber),
  CASE WHEN count(DISTINCT l_linenumber) > 20 THEN 'regression' ELSE 'classification' END,
  CASE WHEN count(DISTINCT l_linenumber) > 20 THEN 'regression'
       WHEN count(DISTINCT l_linenumber) <= 2 THEN 'binary_classification'
       ELSE 'multiclass_classification' END FROM lineitem
UNION ALL
SELECT 'l_linestatus', count(DISTINCT l_linestatus), 'classification',
  CASE WHEN count(DISTINCT l_linestatus) <= 2 THEN 'binary_classification'
       ELSE 'multiclass_classification' END FROM lineitem
UNION ALL
SELECT 'l_returnflag', count(DISTINCT l_returnflag), 'classification',
  CASE WHEN count(DISTINCT l_returnflag) <= 2 THEN 'binary_classification'
       ELSE 'multiclass_classification' END FROM lineitem""")
def q_infer_task(spark, sf):
    li = load_table(spark, sf, "lineitem")
    out = None
    for t in ["l_quantity", "l_linenumber", "l_linestatus", "l_returnflag"]:
        r = P.infer_task(li, t)
        out = r if out is None else out.unionByName(r)
    return out


@register("infer_task_3way", """
WITH p AS (""" + _profile_sql("lineitem", LINEITEM) + """)
SELECT column_name, semantic_type, unique_count,
  CASE WHEN semantic_type = 'numeric' AND unique_count > 20 THEN 'regression'
       WHEN unique_count <= 2 THEN 'binary_classification'
       ELSE 'multiclass_classification' END AS task FROM p""")
def q_infer_task_3way(spark, sf):
    return P.infer_task_from_profile(P.profile_dataset(load_table(spark, sf, "lineitem")))


@register("target_classes", """
SELECT CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS BIGINT) AS class_index,
  l_returnflag AS class_label FROM (SELECT DISTINCT l_returnflag FROM lineitem)""")
def q_target_classes(spark, sf):
    return P.target_classes(load_table(spark, sf, "lineitem"), "l_returnflag")


INPUT_SCHEMA = {
    "type": "object",
    "properties": {
        "l_quantity": {"type": "number"},
        "l_returnflag": {"type": "string", "enum": ["A", "N"]},
        "l_linenumber": {"type": "integer"},
        "l_tax": {"type": "number"},
    },
    "required": ["l_quantity", "l_returnflag"],
    "additionalProperties": False,
}


@register("apply_input_schema", """
SELECT CAST(l_quantity AS DOUBLE) AS l_quantity, l_returnflag,
  CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_tax AS DOUBLE) AS l_tax
FROM lineitem WHERE l_returnflag IN ('A', 'N')""")
def q_apply_input_schema(spark, sf):
    li = load_table(spark, sf, "lineitem")
    # the incoming rows are text, as a request body would be
    raw = li.select(*[F.col(c).cast("string").alias(c) for c in li.columns])
    valid, _quarantine = P.apply_input_schema(raw, INPUT_SCHEMA)
    return valid


@register("profile_dataset_overrides", """
WITH raw AS (SELECT l_orderkey, l_returnflag,
  CASE WHEN l_orderkey % 7 = 0 THEN 'not a date ' || CAST(l_orderkey AS VARCHAR)
       ELSE strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') END AS l_shipdate,
  CAST(l_quantity AS VARCHAR) AS l_quantity FROM lineitem),
c AS (SELECT l_orderkey, l_returnflag, try_strptime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate,
  TRY_CAST(l_quantity AS DOUBLE) AS l_quantity FROM raw)
SELECT 'l_shipdate' AS column_name, 'string' AS inferred_type, 'datetime' AS semantic_type,
  count(l_shipdate) AS count, round((count(*) - count(l_shipdate)) * 100.0::DOUBLE / count(*), 6) AS missing_pct,
  count(DISTINCT l_shipdate) AS unique_count, CAST(NULL AS DOUBLE) AS mean FROM c
UNION ALL
SELECT 'l_quantity', 'string', 'numeric', count(l_quantity),
  round((count(*) - count(l_quantity)) * 100.0::DOUBLE / count(*), 6), count(DISTINCT l_quantity),
  round(CAST(sum(CAST(l_quantity AS DECIMAL(38,6))) AS DOUBLE) / count(l_quantity), 6) FROM c
UNION ALL
SELECT 'l_returnflag', 'string', 'text', count(l_returnflag), 0.0, count(DISTINCT l_returnflag),
  CAST(NULL AS DOUBLE) FROM c
UNION ALL
SELECT 'l_orderkey', 'bigint', 'numeric', count(*), 0.0, count(DISTINCT l_orderkey),
  round(CAST(sum(CAST(l_orderkey AS DECIMAL(38,6))) AS DOUBLE) / count(*), 6) FROM c""")
def q_profile_dataset_overrides(spark, sf):
    """Re-profile with user types: text dates read as datetime, text numbers
    as numeric (bad values become missing), a categorical forced to text."""
    li = load_table(spark, sf, "lineitem")
    raw = li.select(
        "l_orderkey", "l_returnflag",
        F.when(F.col("l_orderkey") % 7 == 0,
               F.concat(F.lit("not a date "), F.col("l_orderkey").cast("string")))
         .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")).alias("l_shipdate"),
        F.col("l_quantity").cast("string").alias("l_quantity"))
    prof = P.profile_dataset(raw, {"l_shipdate": "datetime", "l_quantity": "numeric",
                                   "l_returnflag": "text"})
    return prof.select("column_name", "inferred_type", "semantic_type", "count", "missing_pct",
                       "unique_count", "mean")
