"""Profiling, semantic type inference and validation (one aggregate pass).

The whole-table statistics of every column come from ONE ``agg`` (partial
aggregation on the map side, one tiny row to reduce).  Distinct counts come
from an unpivot to ``(column, value)`` followed by two group-bys, so a wide
table does not multiply its rows through one ``Expand`` per distinct
aggregate, and a value that holds a third of the table is combined on the map
side before any shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomkit.functions.exprs import with_scalars
from pyspark.sql import types as T

from loomkit.functions.prefix import dense_index

SEMANTIC_TYPES = ("numeric", "categorical", "datetime", "boolean", "text")

# The suggested transform per semantic type.
SUGGESTED_TRANSFORM = {
    "numeric": "standardize",
    "categorical": "one-hot",
    "boolean": "keep",
    "datetime": "keep",
    "text": "drop",
}

# The datetime formats tried, in order, when coercing text.
DATETIME_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd",
    "MM/dd/yyyy",
    "MM/dd/yyyy HH:mm:ss",
    "MMM d, yyyy",
)


# ---------------------------------------------------------------- type tests

def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def is_datetime_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_float_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.FloatType, T.DoubleType))


def _clean(df: DataFrame, name: str) -> Column:
    """Column with NaN turned into NULL (pandas treats NaN as missing)."""
    c = F.col(name)
    if is_float_type(df.schema[name].dataType):
        return F.nanvl(c, F.lit(None).cast(df.schema[name].dataType))
    return c


# ---------------------------------------------------------------- coercion

def coerce_expr(c: Column, semantic: str) -> Column:
    """Re-read a column under a user-chosen semantic type; bad values -> NULL."""
    if semantic == "datetime":
        s = c.cast("string")
        return F.coalesce(*[F.try_to_timestamp(s, F.lit(fmt)) for fmt in DATETIME_FORMATS])
    if semantic == "numeric":
        return c.try_cast("double")
    if semantic == "boolean":
        return c.try_cast("boolean")
    return c


def coerce_semantic(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Apply ``coerce_expr`` to the columns named in ``types``."""
    cols = [coerce_expr(F.col(c), types[c]).alias(c) if c in types else F.col(c)
            for c in df.columns]
    return df.select(*cols)


# ---------------------------------------------------------------- pieces

def profile_shape(df: DataFrame) -> DataFrame:
    """``(n_rows, n_cols)``."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_cols", F.lit(len(df.columns)).cast("long"))


def _long_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Unpivot to ``(column_name, lv, dv, sv)`` with NaN and NULL removed.

    Integral and datetime values travel as longs, floats as doubles (-0.0
    folded into 0.0), everything else as text: no per-row number formatting.
    """
    pairs = []
    null_l, null_d, null_s = (F.lit(None).cast("long"), F.lit(None).cast("double"),
                              F.lit(None).cast("string"))
    for c in columns:
        dt = df.schema[c].dataType
        v = _clean(df, c)
        lv, dv, sv = null_l, null_d, null_s
        if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            lv = v.cast("long")
        elif isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
            lv = F.unix_micros(v.cast("timestamp"))
        elif isinstance(dt, T.DateType):
            lv = F.unix_date(v).cast("long")
        elif is_float_type(dt):
            dv = v.cast("double") + F.lit(0.0)
        else:
            sv = v.cast("string")
        pairs.append(F.struct(F.lit(c).alias("column_name"), lv.alias("lv"), dv.alias("dv"),
                              sv.alias("sv")))
    return (df.select(F.explode(F.array(*pairs)).alias("kv"))
              .select("kv.*")
              .where(F.col("lv").isNotNull() | F.col("dv").isNotNull() | F.col("sv").isNotNull()))


def profile_unique(df: DataFrame, columns: list[str] | None = None,
                   approx: bool = False) -> DataFrame:
    """Distinct non-null values per column: ``(column_name, unique_count)``."""
    columns = columns or df.columns
    if approx:
        row = df.agg(*[F.approx_count_distinct(_clean(df, c)).alias(c) for c in columns])
        return _unpivot_row(row, columns, "unique_count")
    long = _long_values(df, columns)
    return (long.distinct()
                .groupBy("column_name").agg(F.count(F.lit(1)).alias("unique_count")))


def _unpivot_row(row: DataFrame, columns: list[str], name: str) -> DataFrame:
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("long").alias(name))
        for c in columns])).alias("kv")).select("kv.*")


def _stat_aggs(df: DataFrame, columns: list[str]) -> list[Column]:
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(columns):
        v = _clean(df, c)
        aggs.append(F.count(v).alias(f"c{i}_count"))
        if is_numeric_type(df.schema[c].dataType):
            d = v.cast("double")
            aggs += [F.avg(d).alias(f"c{i}_mean"), F.stddev_samp(d).alias(f"c{i}_std"),
                     F.min(d).alias(f"c{i}_min"), F.max(d).alias(f"c{i}_max")]
    return aggs


def _stats_long(df: DataFrame, columns: list[str]) -> DataFrame:
    """One aggregate pass, then unpivot to one row per column."""
    wide = df.agg(*_stat_aggs(df, columns))
    null_d = F.lit(None).cast("double")
    rows = []
    for i, c in enumerate(columns):
        num = is_numeric_type(df.schema[c].dataType)
        rows.append(F.struct(
            F.lit(c).alias("column_name"),
            F.lit(i).alias("ordinal"),
            F.col("__n").alias("n_rows"),
            F.col(f"c{i}_count").alias("count"),
            (F.col(f"c{i}_mean") if num else null_d).alias("mean"),
            (F.col(f"c{i}_std") if num else null_d).alias("std"),
            (F.col(f"c{i}_min") if num else null_d).alias("min"),
            (F.col(f"c{i}_max") if num else null_d).alias("max"),
        ))
    return wide.select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def profile_missing(df: DataFrame) -> DataFrame:
    """``(column_name, missing_pct)``; NaN counts as missing."""
    s = _stats_long(df, df.columns)
    return s.select("column_name", _missing_pct(s).alias("missing_pct"))


def _missing_pct(s: DataFrame) -> Column:
    return F.try_divide((F.col("n_rows") - F.col("count")) * F.lit(100.0), F.col("n_rows"))


def profile_numeric_stats(df: DataFrame) -> DataFrame:
    """count, mean, sample std, min, max of numeric columns, one pass."""
    cols = [c for c in df.columns if is_numeric_type(df.schema[c].dataType)]
    s = _stats_long(df, cols)
    return s.select("column_name", "count", "mean", "std",
                    "min", "max")


# ---------------------------------------------------------------- semantics

def _physical_kind(dt: T.DataType) -> str:
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if is_numeric_type(dt):
        return "numeric"
    if is_datetime_type(dt):
        return "datetime"
    return "other"


def semantic_expr(kind: str, n_rows: Column, n_unique: Column) -> Column:
    """The profiler's rule: ``0 < nunique <= max(20, int(0.05 n))`` -> categorical."""
    if kind != "other":
        return F.lit(kind)
    limit = F.greatest(F.lit(20), F.floor(n_rows * F.lit(0.05)))
    return F.when((n_unique > 0) & (n_unique <= limit), F.lit("categorical")).otherwise("text")


def coarse_expr(kind: str, n_rows: Column, n_unique: Column) -> Column:
    """The trainer's rule: booleans are categorical, ``nunique <= max(50, int(sqrt n))``."""
    if kind == "numeric":
        return F.lit("numeric")
    if kind == "boolean":
        return F.lit("categorical")
    if kind == "datetime":
        return F.lit("datetime")
    limit = F.greatest(F.lit(50), F.floor(F.sqrt(n_rows.cast("double"))))
    return F.when(n_unique <= limit, F.lit("categorical")).otherwise("text")


def _kind_column(df: DataFrame, columns: list[str]) -> Column:
    m = F.create_map(*[x for c in columns
                       for x in (F.lit(c), F.lit(_physical_kind(df.schema[c].dataType)))])
    return m[F.col("column_name")]


def infer_semantic(df: DataFrame) -> DataFrame:
    """``(column_name, semantic_type)`` by the profiler's rule."""
    prof = profile_dataset(df)
    return prof.select("column_name", "semantic_type")


def coarse_schema(df: DataFrame, user_types: dict[str, str] | None = None) -> DataFrame:
    """``(column_name, coarse_type)`` by the trainer's rule, overrides first."""
    user_types = {k: v for k, v in (user_types or {}).items() if v in SEMANTIC_TYPES}
    cols = df.columns
    # only text-like columns need a distinct count; the rest is decided by type
    other = [c for c in cols if c not in user_types
             and _physical_kind(df.schema[c].dataType) == "other"]
    n = df.agg(F.count(F.lit(1)).alias("n_rows"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column_name string")
    base = with_scalars(names, n)
    if other:
        base = base.join(profile_unique(df, other), "column_name", "left")
    else:
        base = base.withColumn("unique_count", F.lit(None).cast("long"))
    base = base.withColumn("unique_count", F.coalesce("unique_count", F.lit(0)))
    out = None
    for c in cols:
        if c in user_types:
            e = F.lit("categorical" if user_types[c] == "boolean" else user_types[c])
        else:
            e = coarse_expr(_physical_kind(df.schema[c].dataType), F.col("n_rows"),
                            F.col("unique_count"))
        out = (F.when(F.col("column_name") == c, e) if out is None
               else out.when(F.col("column_name") == c, e))
    return base.select("column_name", out.alias("coarse_type"))


def coarse_schema_dict(df: DataFrame, user_types: dict[str, str] | None = None) -> dict:
    """The same as a Python dict (one row per column reaches the driver)."""
    return {r.column_name: r.coarse_type for r in coarse_schema(df, user_types).collect()}


def profile_dataset(df: DataFrame, user_types: dict[str, str] | None = None,
                    approx_distinct: bool = False) -> DataFrame:
    """One row per column with type, semantic type, stats, missing %, uniques.

    ``user_types`` (column -> semantic type) overrides inference; the column
    is coerced first, so bad values become NULL and count as missing.
    """
    user_types = {k: v for k, v in (user_types or {}).items() if v in SEMANTIC_TYPES}
    inferred = {c: df.schema[c].dataType.simpleString() for c in df.columns}
    if user_types:
        df = coerce_semantic(df, user_types)
    cols = df.columns
    stats = _stats_long(df, cols)
    uniq = profile_unique(df, cols, approx=approx_distinct)
    j = stats.join(uniq, "column_name", "left").withColumn(
        "unique_count", F.coalesce(F.col("unique_count"), F.lit(0)).cast("long"))
    sem = None
    for c in cols:
        kind = _physical_kind(df.schema[c].dataType)
        e = F.lit(user_types[c]) if c in user_types else semantic_expr(
            kind, F.col("n_rows"), F.col("unique_count"))
        sem = (F.when(F.col("column_name") == c, e) if sem is None
               else sem.when(F.col("column_name") == c, e))
    itype = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(inferred[c]))])
    j = j.withColumn("semantic_type", sem).withColumn("inferred_type", itype[F.col("column_name")])
    sugg = F.create_map(*[x for k, v in SUGGESTED_TRANSFORM.items() for x in (F.lit(k), F.lit(v))])
    st = F.col("semantic_type")
    suit = F.concat_ws(
        ",", F.lit("supervised"),
        F.when(st.isin("numeric", "categorical", "boolean"), F.lit("clustering")),
        F.when(st.isin("numeric", "datetime"), F.lit("forecasting")),
        F.when(st.isin("numeric", "categorical", "boolean"), F.lit("recommender")))
    miss = _missing_pct(j)
    return j.select(
        "column_name", "ordinal", "inferred_type", "semantic_type",
        F.col("count").cast("long").alias("count"),
        "mean", "std",
        "min", "max",
        miss.alias("missing_pct"),
        F.col("unique_count"),
        (miss / F.lit(100.0)).alias("null_fraction"),
        sugg[st].alias("suggested_transform"),
        suit.alias("suitable_for"),
    )


# ---------------------------------------------------------------- task rules

def infer_task(df: DataFrame, target: str) -> DataFrame:
    """``(target, n_unique, task, task_3way)`` from the target column."""
    dt = df.schema[target].dataType
    numeric = is_numeric_type(dt) and not isinstance(dt, T.BooleanType)
    nu = df.agg(F.count_distinct(_clean(df, target)).alias("n_unique"))
    n = F.col("n_unique")
    task = F.when(F.lit(numeric) & (n > 20), "regression").otherwise("classification")
    three = F.when(F.lit(numeric) & (n > 20), "regression") \
             .when(n <= 2, "binary_classification").otherwise("multiclass_classification")
    return nu.select(F.lit(target).alias("target"), n.cast("long").alias("n_unique"),
                     task.alias("task"), three.alias("task_3way"))


def infer_task_from_profile(profile: DataFrame) -> DataFrame:
    """The UI variant: decided from (semantic type, unique count) only."""
    st, u = F.col("semantic_type"), F.col("unique_count")
    task = (F.when((st == "numeric") & (u > 20), "regression")
             .when(u <= 2, "binary_classification")
             .otherwise("multiclass_classification"))
    return profile.select("column_name", "semantic_type", "unique_count", task.alias("task"))


def target_classes(df: DataFrame, target: str) -> DataFrame:
    """Sorted distinct non-null target values: ``(class_index, class_label)``.

    One row per class (never one array built in one task); the order is the
    native order of the column, the label its string form.
    """
    idx = dense_index(df.select(_clean(df, target).alias(target)), target, "class_index")
    return idx.select("class_index", F.col(target).cast("string").alias("class_label"))


# ---------------------------------------------------------------- input schema

_JSON_TO_SPARK = {
    "string": "string", "integer": "bigint", "number": "double", "boolean": "boolean",
}


def _declared_type(spec: dict) -> str | None:
    """Spark type of a property; of a union the first member that has one, none
    for types without a Spark form (arrays, objects)."""
    said = spec.get("type", "string")
    members = [said] if isinstance(said, str) else list(said)
    known = [_JSON_TO_SPARK[m] for m in members if m in _JSON_TO_SPARK]
    return known[0] if known else ("string" if members == ["null"] else None)


def apply_input_schema(df: DataFrame, schema: dict) -> tuple[DataFrame, DataFrame]:
    """Project rows onto a JSON-Schema object; returns ``(valid, quarantine)``.

    Declared properties are cast with ``try_cast``; extra columns are dropped
    unless ``additionalProperties`` is true.  A row is quarantined when a
    required property is missing / unparseable or an ``enum`` is violated;
    ``reason`` names the first failing property.  A schema that is not an
    object, or whose property is not one, accepts text.
    """
    schema = schema if isinstance(schema, dict) else {}
    declared = {name: spec if isinstance(spec, dict) else {}
                for name, spec in (schema.get("properties") or {}).items()}

    def value(name: str, spec: dict) -> Column:
        if name not in df.columns:
            return F.lit(spec.get("default"))
        to = _declared_type(spec)
        return F.col(f"`{name}`").try_cast(to) if to else F.col(f"`{name}`")

    def faults(name: str, spec: dict) -> list[Column]:
        got, out = F.col(f"`{name}`"), []
        if name in (schema.get("required") or ()):
            out.append(F.when(got.isNull(), f"missing or invalid: {name}"))
        if allowed := spec.get("enum"):
            inside = got.cast("string").isin([str(x) for x in allowed])
            out.append(F.when(got.isNotNull() & ~inside, f"not in enum: {name}"))
        return out

    passed = [c for c in df.columns if c not in declared] if schema.get("additionalProperties") is True else []
    rows = df.select(*[value(n, s).alias(n) for n, s in declared.items()], *[F.col(f"`{c}`") for c in passed])
    found = [x for n, s in declared.items() for x in faults(n, s)]
    judged = rows.withColumn("reason", F.coalesce(*found) if found else F.lit(None).cast("string"))
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def min_length_required(horizon: int) -> int:
    return max(horizon + 5, 20)


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "math")]
