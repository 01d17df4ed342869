"""Per-column feature transforms: fit on train, apply to any frame.

Each op contributes aggregate expressions; ``fit_ops`` evaluates the
aggregates of *all* ops in ONE pass over the training frame, plus one pass
that builds the category dictionary of all encoders: a table of (column,
value, code) of any size.  Ops with few categories are applied as literal
constants in one projection; larger dictionaries are joined, and a one-hot of
that size is one sparse vector column (``params["sparse"]`` forces either form).

Semantics follow the scikit-learn defaults the reference relies on:
population std with zero std -> 1, min-max with constant column -> range
minimum, ``log1p`` with x < -1 -> NaN, mode ties -> smallest value.  A missing
value (NULL or NaN) seen in training is a category of its own, the last one:
one-hot gives it the column ``<c>_nan``, ordinal the ``encoded_missing_value``
(NaN by default).  Unknown values are all zeros in one-hot and -1 in ordinal;
under ``min_frequency`` rare values are pooled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


LITERAL_CATEGORIES = 200  # up to here an encoder is a projection; beyond, a join with the same codes
MISSING = "nan"  # fixed value: name of the missing category
INFREQUENT = "infrequent_sklearn"  # fixed value: name of the pooled rare bucket


def _isnum(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.NumericType)


def _clean_num(c: str) -> Column:
    x = F.col(f"`{c}`").cast("double")
    return F.nanvl(x, F.lit(None).cast("double"))


@dataclass
class ColumnOp:
    """One declarative entry ``{column, op, params}``; ``key`` names its branch."""

    column: str
    op: str
    params: dict = field(default_factory=dict)
    key: str = ""
    stats: dict = field(default_factory=dict)
    categories: list = field(default_factory=list)  # values by code, None for the missing one; small dictionaries only
    width: int = 0  # number of codes
    dictionary: DataFrame | None = None  # (val, code) of a large one

    # ---- fitting -------------------------------------------------------
    def aggs(self, df: DataFrame) -> list[Column]:
        c, k = self.column, self.key
        x = _clean_num(c)
        if self.op == "standard_scale":
            return [F.avg(x).alias(f"{k}__mean"), F.stddev_pop(x).alias(f"{k}__std")]
        if self.op == "min_max":
            return [F.min(x).alias(f"{k}__min"), F.max(x).alias(f"{k}__max")]
        if self.op == "impute_mean":
            return [F.avg(x).alias(f"{k}__fill")]
        if self.op == "impute_median":
            return []  # exact distributed median in fit_ops (values never gathered)
        if self.op == "impute_mode":
            return []  # distributed value counts in fit_ops (ties -> smallest value)
        if self.op == "date_features":
            parts = date_parts(F.col(f"`{c}`"))
            out = [F.max(F.when(has_time_part(F.col(f"`{c}`")), 1).otherwise(0))
                   .alias(f"{k}__hastime")]
            for name, e in parts.items():
                v = e.cast("double")
                out += [F.median(v).alias(f"{k}__{name}_med")]
            return out
        return []

    def needs_categories(self) -> bool:
        return self.op in ("one_hot", "ordinal", "label")

    def second_pass_aggs(self, df: DataFrame) -> list[Column]:
        """Aggregates that need the first pass (date features: scale after impute)."""
        if self.op != "date_features":
            return []
        c, k = self.column, self.key
        out = []
        for name, e in date_parts(F.col(f"`{c}`")).items():
            v = F.coalesce(e.cast("double"), F.lit(self.stats.get(f"{k}__{name}_med")))
            out += [F.avg(v).alias(f"{k}__{name}_mean"),
                    F.stddev_pop(v).alias(f"{k}__{name}_std")]
        return out

    # ---- applying ------------------------------------------------------
    def outputs(self) -> list[tuple[str, Column]]:
        c, k, s, p = self.column, self.key, self.stats, self.params
        x = _clean_num(c)
        if self.op in ("none", "passthrough"):
            return [(c, F.col(f"`{c}`").cast("double"))]
        if self.op == "standard_scale":
            mean = s[f"{k}__mean"] if p.get("with_mean", True) else 0.0
            std = s[f"{k}__std"] if p.get("with_std", True) else 1.0
            std = 1.0 if not std else std
            return [(c, (x - F.lit(mean or 0.0)) / F.lit(std))]
        if self.op == "min_max":
            a, b = p.get("feature_range", (0, 1))
            lo, hi = s[f"{k}__min"], s[f"{k}__max"]
            rng = (hi - lo) if (hi is not None and lo is not None and hi != lo) else 1.0
            lo = lo if lo is not None else 0.0
            return [(c, (x - F.lit(lo)) * F.lit(float(b - a) / rng) + F.lit(float(a)))]
        if self.op == "log":
            return [(c, F.when(x < -1, F.lit(float("nan")))
                       .when(x == -1, F.lit(float("-inf"))).otherwise(F.log1p(x)))]
        if self.op in ("impute_mean", "impute_median", "impute_mode"):
            fill = s.get(f"{k}__fill")
            base = x if self.op != "impute_mode" or isinstance(fill, (int, float)) \
                else F.col(f"`{c}`")
            return [(c, F.coalesce(base, F.lit(fill)))]
        if self.op == "one_hot":
            return self._one_hot()
        if self.op in ("ordinal", "label"):
            unknown, missing = float(p.get("unknown_value", -1)), float(p.get("encoded_missing_value", "nan"))
            if self.dictionary is not None:
                code = F.col(self.code_column())
                known = F.when(code.isNotNull() & self.value().isNull(), F.lit(missing)).otherwise(code)
                return [(c, F.coalesce(known, F.lit(unknown)))]
            pairs = [e for i, v in enumerate(self.categories) if v is not None for e in (F.lit(v), F.lit(float(i)))]
            code = F.create_map(*pairs)[self.value()] if pairs else F.lit(None).cast("double")
            if None in self.categories:
                code = F.when(self.value().isNull(), F.lit(missing)).otherwise(code)
            return [(c, F.coalesce(code, F.lit(unknown)))]
        if self.op == "date_features":
            out = []
            for name, e in date_parts(F.col(f"`{c}`")).items():
                if name == "hour" and not s.get(f"{k}__hastime"):
                    continue
                med = s.get(f"{k}__{name}_med")
                v = F.coalesce(e.cast("double"), F.lit(med))
                mean, std = s.get(f"{k}__{name}_mean") or 0.0, s.get(f"{k}__{name}_std") or 0.0
                out.append((f"{c}_{name}", (v - F.lit(mean)) / F.lit(std if std else 1.0)))
            return out
        raise ValueError(f"unknown transform op: {self.op!r}")

    def value(self) -> Column:
        """The column as the dictionaries hold it: text, NULL where missing."""
        v = F.col(f"`{self.column}`").cast("string")
        return F.when(v != "NaN", v) if self.stats.get("floating") else v

    def code_column(self) -> str:
        return "_code_" + re.sub(r"[^0-9A-Za-z_]", "_", f"{self.key}_{self.column}")

    def _one_hot(self) -> list[tuple[str, Column]]:
        c, v, rare = self.column, self.value(), self.stats.get("rare", [])
        if self.dictionary is not None:
            return [(f"{c}_onehot", F.col(f"`{self.code_column()}`"))]
        hit = lambda cat: v.isNull() if cat is None else F.coalesce(v == F.lit(cat), F.lit(False))
        out = [(f"{c}_{MISSING if cat is None else cat}", hit(cat).cast("double")) for cat in self.categories]
        if rare:
            any_rare = hit(rare[0])
            for cat in rare[1:]:
                any_rare = any_rare | hit(cat)
            out.append((f"{c}_{INFREQUENT}", any_rare.cast("double")))
        return out

    def join_codes(self, df: DataFrame) -> DataFrame:
        """``df`` with this op's code column: a left join on the value, NULL included."""
        codes = self.dictionary.select(F.col("val").alias("_val"), F.col("code").cast("double").alias("_code"))
        out = df.join(codes, self.value().eqNullSafe(F.col("_val")), "left").drop("_val")
        if self.op != "one_hot":
            return out.withColumnRenamed("_code", self.code_column())
        # a code beyond the last is invalid to Spark's encoder: all zeros
        from pyspark.ml.feature import OneHotEncoder
        top = df.sparkSession.createDataFrame([(float(self.width - 1),)], "_code double")
        model = OneHotEncoder(inputCols=["_code"], outputCols=[self.code_column()], handleInvalid="keep").fit(top)
        return model.transform(out.fillna(float(self.width), ["_code"])).drop("_code")


def with_codes(df: DataFrame, ops: list) -> DataFrame:
    """``df`` with the code columns that the outputs of large encoders read."""
    for op in ops:
        if getattr(op, "dictionary", None) is not None:
            df = op.join_codes(df)
    return df


def date_parts(ts: Column) -> dict[str, Column]:
    """year, month, day, dow (Mon=0), quarter, hour; NULL if unparseable."""
    t = ts.try_cast("timestamp_ntz")
    return {
        "year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t),
        "dow": F.weekday(t), "quarter": F.quarter(t), "hour": F.hour(t),
    }


def has_time_part(ts: Column) -> Column:
    t = ts.try_cast("timestamp_ntz")
    return (F.hour(t) != 0) | (F.minute(t) != 0) | (F.second(t) != 0)


OPS = ("none", "passthrough", "standard_scale", "min_max", "log", "one_hot", "ordinal", "label",
       "date_features", "impute_mean", "impute_median", "impute_mode", "drop")


def fit_ops(train: DataFrame, ops: list[ColumnOp]) -> list[ColumnOp]:
    """Fit every op: one aggregate pass (+ one for categories, + one for date scaling)."""
    for op in ops:
        if op.op not in OPS:
            raise ValueError(f"unknown transform op: {op.op!r}")
    aggs = [a for op in ops for a in op.aggs(train)]
    if aggs:
        row = train.agg(*aggs).first().asDict()
        for op in ops:
            op.stats.update({k: v for k, v in row.items() if k.startswith(f"{op.key}__")})
    for op in ops:
        if op.op == "impute_median":
            from loomkit.functions.prefix import exact_median
            op.stats[f"{op.key}__fill"] = exact_median(train, op.column)
        elif op.op == "impute_mode":
            # counts per distinct value (map-side combined), then the top one by
            # (count desc, value asc): a per-partition top-1, never one big map
            c = op.column
            v = _clean_num(c) if _isnum(train, c) else F.col(f"`{c}`")
            top = train.select(v.alias("v")).where(F.col("v").isNotNull()) \
                       .groupBy("v").agg(F.count(F.lit(1)).alias("n")) \
                       .orderBy(F.col("n").desc(), F.col("v")).limit(1).collect()
            op.stats[f"{op.key}__fill"] = top[0]["v"] if top else None
    second = [a for op in ops for a in op.second_pass_aggs(train)]
    if second:
        row = train.agg(*second).first().asDict()
        for op in ops:
            op.stats.update({k: v for k, v in row.items() if k.startswith(f"{op.key}__")})
    enc = [op for op in ops if op.needs_categories()]
    if enc:
        _fit_categories(train, enc)
    return ops


def _fit_categories(train: DataFrame, enc: list[ColumnOp]) -> None:
    """The dictionary of every encoded column: its distinct values, missing last,
    with their position in sorted order (numbers as numbers, text as text).

    One unpivot, one group-by and one bucketed prefix sum for all columns; only
    the sizes per column and the small dictionaries reach the driver.
    """
    from loomkit.functions.prefix import prefix_sums
    from loomkit.session import cut_lineage

    cols = sorted({op.column for op in enc})
    numeric = {c: _isnum(train, c) for c in cols}
    for op in enc:
        op.stats["floating"] = isinstance(train.schema[op.column].dataType, (T.FloatType, T.DoubleType))
    value = {op.column: op.value() for op in enc}
    pairs = F.array(*[F.struct(F.lit(c).alias("col"), value[c].alias("val"),
                               (value[c].try_cast("double") if numeric[c] else F.lit(0.0)).alias("num"))
                      for c in cols])
    counts = cut_lineage(
        train.select(F.explode(pairs).alias("p")).select("p.*").groupBy("col", "val")
        .agg(F.max(F.coalesce("num", F.lit(0.0))).alias("num"), F.count(F.lit(1)).alias("n"))
        .withColumn("missing", F.col("val").isNull().cast("int")).withColumn("text", F.coalesce("val", F.lit(""))))
    totals = {r["col"]: (r["t"], r["c"]) for r in
              counts.groupBy("col").agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("c")).collect()}

    def coded(rows: DataFrame) -> DataFrame:
        return prefix_sums(rows.withColumn("one", F.lit(1)), ["missing", "num", "text"], ["one"], prefix="at_",
                           group_cols=["col"]).select("col", "val", F.col("at_one").alias("code"), "n")

    plain = None
    for op in enc:
        total, size = totals.get(op.column, (0, 0))
        mf = op.params.get("min_frequency") if op.op == "one_hot" else None
        limit = 0 if not mf else mf * total if isinstance(mf, float) and mf < 1 else mf
        mine = F.col("col") == op.column
        sparse = op.params.get("sparse", size > LITERAL_CATEGORIES)
        if not sparse:
            order = ["missing", "num", "text"]
            rows = counts.where(mine).orderBy(*order).collect()
            op.categories = [r["val"] for r in rows if r["n"] >= limit]
            op.stats["rare"] = [r["val"] for r in rows if r["n"] < limit]
            op.width = len(op.categories) + bool(op.stats["rare"])
        elif not limit:
            if plain is None:
                plain = cut_lineage(coded(counts))
            op.dictionary, op.width = plain.where(mine), size
        else:
            often = cut_lineage(coded(counts.where(mine & (F.col("n") >= limit))))
            op.width = often.count()
            rare = counts.where(mine & (F.col("n") < limit)).select("col", "val", F.lit(op.width).alias("code"), "n")
            op.dictionary, op.width = often.unionByName(rare), op.width + (op.width < size)


def apply_ops(df: DataFrame, ops: list[ColumnOp], keep: list[str] | None = None) -> DataFrame:
    """Project the fitted ops (plus ``keep`` columns) onto any frame."""
    df = with_codes(df, ops)
    cols = [F.col(f"`{c}`") for c in (keep or [])]
    names = []
    for op in ops:
        for name, e in op.outputs():
            names.append(name)
            cols.append(e.alias(name))
    return df.select(*cols)


def fit_transform_one(train: DataFrame, apply_to: DataFrame, column: str, op: str,
                      params: dict | None = None, keep: list[str] | None = None) -> DataFrame:
    """Fit one op on ``train`` and apply it to ``apply_to``."""
    o = ColumnOp(column, op, params or {}, key=f"0_{op}_{column}")
    fit_ops(train, [o])
    return apply_ops(apply_to, [o], keep)


# ---------------------------------------------------------------- targets

def encode_target(df: DataFrame, target: str, classes: DataFrame,
                  out: str = "label") -> DataFrame:
    """Replace a non-numeric target by its sorted class index (``target_classes``).

    ``classes`` has one row per class; it is joined (AQE broadcasts it after
    measuring it, it never needs a driver round trip).
    """
    m = classes.select(F.col("class_label").alias("_cls"), F.col("class_index").alias(out))
    return df.join(m, F.col(target).cast("string") == F.col("_cls"), "left").drop("_cls")


def decode_label(pred_idx: Column, classes: list[str], encoded: bool) -> Column:
    """Class index -> label, only in range and only if the target was encoded
    (or the class list is non-numeric); else the prediction as text."""
    arr = F.array(*[F.lit(c) for c in classes])
    numeric_classes = all(_is_number(c) for c in classes)
    use = encoded or not numeric_classes
    idx = pred_idx.cast("int")
    in_range = (idx >= 0) & (idx < len(classes))
    if not use:
        return pred_idx.cast("string")
    return F.when(in_range, F.try_element_at(arr, idx + 1)).otherwise(pred_idx.cast("string"))


def _is_number(s: Any) -> bool:
    try:
        float(s)
        return True
    except (TypeError, ValueError):
        return False
