"""Group fairness reports: per-group metric, parity gaps, deltas, caps.

Everything is one ``groupBy`` over the sensitive columns (map-side combined,
so a group holding a third of the rows costs one partial aggregate per task)
followed by aggregates over the per-group table, whose size is the number of
groups, not rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomkit.functions.exprs import with_scalars


GROUP_CAP = 200


def _metric_expr(y: Column, p: Column, metric: str) -> Column:
    if metric == "accuracy":
        return F.avg((y == p).cast("double"))
    if metric == "mae":
        return F.avg(F.abs(y.cast("double") - p.cast("double")))
    raise ValueError(f"unsupported fairness metric: {metric!r}")


def group_label(sensitive: list[str]) -> Column:
    """Composite group label ``a|b`` (one column: its value)."""
    return F.concat_ws("|", *[F.col(c).cast("string") for c in sensitive])


def by_group(df: DataFrame, y: str, p: str, sensitive: list[str],
             metric: str = "accuracy") -> DataFrame:
    """Per group: label, metric value, support, overall value and delta."""
    yy, pp = F.col(y), F.col(p)
    groups = df.groupBy(*sensitive).agg(_metric_expr(yy, pp, metric).alias("value"),
                                        F.count(F.lit(1)).alias("support"))
    overall = df.agg(_metric_expr(yy, pp, metric).alias("overall"))
    out = with_scalars(groups, overall)
    return out.select(*sensitive, group_label(sensitive).alias("group"),
                      F.lit(metric).alias("metric"), "value",
                      "support", "overall",
                      (F.col("value") - F.col("overall")).alias("delta"))


def selection_rates(df: DataFrame, y: str, p: str, sensitive: list[str]) -> DataFrame:
    pos = F.col(p) == 1
    truth = F.col(y) == 1
    return df.groupBy(*sensitive).agg(
        F.avg(pos.cast("double")).alias("selection_rate"),
        F.try_divide(F.sum((pos & truth).cast("double")), F.sum(truth.cast("double")))
        .alias("tpr"),
        F.try_divide(F.sum((pos & ~truth).cast("double")), F.sum((~truth).cast("double")))
        .alias("fpr"))


def demographic_parity(df: DataFrame, p: str, sensitive: list[str], y: str | None = None
                       ) -> DataFrame:
    """max - min of the selection rate P(pred = 1) over groups."""
    rates = df.groupBy(*sensitive).agg(F.avg((F.col(p) == 1).cast("double")).alias("r"))
    return rates.agg((F.max("r") - F.min("r")).alias("demographic_parity_difference"))


def equalized_odds(df: DataFrame, y: str, p: str, sensitive: list[str]) -> DataFrame:
    """max(TPR gap, FPR gap) over groups; emitted under both report names."""
    r = selection_rates(df, y, p, sensitive)
    gap = F.greatest(F.max("tpr") - F.min("tpr"), F.max("fpr") - F.min("fpr"))
    return r.agg(gap.alias("equalized_odds_difference")).withColumn(
        "equal_opportunity_difference", F.col("equalized_odds_difference"))


def cap_groups(groups: DataFrame, sensitive: list[str], cap: int = GROUP_CAP) -> DataFrame:
    """First ``cap`` groups in sorted key order, with ``groups_total`` and
    ``groups_truncated``.  The sort is a per-partition top-``cap``."""
    total = groups.agg(F.count(F.lit(1)).alias("groups_total"))
    kept = groups.orderBy(*sensitive).limit(cap)
    return with_scalars(kept, total).withColumn(
        "groups_truncated", F.col("groups_total") > F.lit(cap))


def report_json(groups: DataFrame, keys: list[str], sensitive: list[str]) -> DataFrame:
    """One JSON report per key: metric, overall, sensitive feature list."""
    return groups.groupBy(*keys).agg(
        F.first("metric").alias("metric"), F.first("overall").alias("overall")
    ).select(*keys, F.to_json(F.struct(
        F.col("metric"), F.col("overall"),
        F.array(*[F.lit(c) for c in sensitive]).alias("sensitive_features"))).alias("report"))


REPORT_SCHEMA = "metric string, overall double, sensitive_features array<string>"


def flatten_reports(reports: DataFrame, key: str, report_col: str = "report") -> DataFrame:
    """One row per report: label (features joined by ``,`` or ``combined``),
    metric name (default accuracy), overall value; bad JSON -> NULLs."""
    parsed = reports.select(key, F.from_json(report_col, REPORT_SCHEMA).alias("r"))
    feats = F.col("r.sensitive_features")
    label = F.when(F.coalesce(F.size(feats), F.lit(0)) > 0, F.array_join(feats, ",")) \
             .otherwise("combined")
    return parsed.select(key, label.alias("sensitive_feature"),
                         F.coalesce(F.col("r.metric"), F.lit("accuracy")).alias("metric_name"),
                         F.col("r.overall").alias("overall_value"))
