"""Queries for fairness (survey 2.9): labels join documents, truth quality,
prediction ``n_chars > 1000``, sensitive columns lang and source."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from loomkit.operators import fairness as FR
from loomkit.plans import registry

from loomkit.session import load_table

# operators do not round; the comparison with the oracle does
register = functools.partial(registry.register, digits=6)

_SRC_SQL = """(SELECT l.doc_id, quality AS y, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS p,
  lang, source, n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def _frame(spark, sf):
    lab = load_table(spark, sf, "labels")
    doc = load_table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return lab.join(doc, "doc_id").select(
        "doc_id", F.col("quality").alias("y"),
        (F.col("n_chars") > 1000).cast("int").alias("p"), "lang", "source", "n_chars")


_BY_GROUP_SQL = f"""
WITH d AS {_SRC_SQL},
o AS (SELECT avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END) AS overall FROM d),
g AS (SELECT lang, source, avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END) AS value, count(*) AS support
      FROM d GROUP BY lang, source)
SELECT lang, source, lang || '|' || source AS "group", 'accuracy' AS metric, round(value, 6) AS value,
  support, round(overall, 6) AS overall, round(value - overall, 6) AS delta FROM g, o"""


@register("fairness_by_group", _BY_GROUP_SQL)
def q_fairness_by_group(spark, sf):
    return FR.by_group(_frame(spark, sf), "y", "p", ["lang", "source"])


@register("fairness_delta", f"""
WITH d AS {_SRC_SQL},
o AS (SELECT avg(abs(y - p)) AS overall FROM d),
g AS (SELECT lang, avg(abs(CAST(y AS DOUBLE) - p)) AS value FROM d GROUP BY lang)
SELECT lang, round(value - overall, 6) AS delta FROM g, o""")
def q_fairness_delta(spark, sf):
    return FR.by_group(_frame(spark, sf), "y", "p", ["lang"], metric="mae").select("lang", "delta")


@register("fairness_demographic_parity", f"""
WITH r AS (SELECT lang, source, avg(CASE WHEN p = 1 THEN 1.0 ELSE 0.0 END) AS r FROM {_SRC_SQL}
           GROUP BY lang, source)
SELECT round(max(r) - min(r), 6) AS demographic_parity_difference FROM r""")
def q_fairness_demographic_parity(spark, sf):
    return FR.demographic_parity(_frame(spark, sf), "p", ["lang", "source"])


@register("fairness_equalized_odds", f"""
WITH r AS (SELECT lang,
  sum(CASE WHEN p = 1 AND y = 1 THEN 1.0 ELSE 0.0 END) / nullif(sum(CASE WHEN y = 1 THEN 1.0 ELSE 0.0 END), 0) AS tpr,
  sum(CASE WHEN p = 1 AND y <> 1 THEN 1.0 ELSE 0.0 END) / nullif(sum(CASE WHEN y <> 1 THEN 1.0 ELSE 0.0 END), 0) AS fpr
  FROM {_SRC_SQL} GROUP BY lang)
SELECT round(greatest(max(tpr) - min(tpr), max(fpr) - min(fpr)), 6) AS equalized_odds_difference,
  round(greatest(max(tpr) - min(tpr), max(fpr) - min(fpr)), 6) AS equal_opportunity_difference FROM r""")
def q_fairness_equalized_odds(spark, sf):
    return FR.equalized_odds(_frame(spark, sf), "y", "p", ["lang"])


# groups are (source, doc length decile): more groups than the cap of 20 used here
@register("fairness_cap", f"""
WITH g AS (SELECT source, CAST(floor(n_chars / 500) AS BIGINT) AS band, count(*) AS support
           FROM {_SRC_SQL} GROUP BY source, CAST(floor(n_chars / 500) AS BIGINT))
SELECT source, band, support, (SELECT count(*) FROM g) AS groups_total,
  (SELECT count(*) FROM g) > 20 AS groups_truncated
FROM g ORDER BY source, band LIMIT 20""")
def q_fairness_cap(spark, sf):
    d = _frame(spark, sf).withColumn("band", F.floor(F.col("n_chars") / 500).cast("bigint"))
    groups = d.groupBy("source", "band").agg(F.count(F.lit(1)).alias("support"))
    return FR.cap_groups(groups, ["source", "band"], cap=20)


@register("fairness_flatten", f"""
WITH d AS {_SRC_SQL}
SELECT source, 'lang' AS sensitive_feature, 'accuracy' AS metric_name,
  round(avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END), 6) AS overall_value FROM d GROUP BY source""")
def q_fairness_flatten(spark, sf):
    d = _frame(spark, sf)
    # one report per source (as a run), over the lang groups of that source
    per = d.groupBy("source", "lang").agg(
        F.avg((F.col("y") == F.col("p")).cast("double")).alias("value"),
        F.count(F.lit(1)).alias("n"))
    overall = d.groupBy("source").agg(
        F.avg((F.col("y") == F.col("p")).cast("double")).alias("overall"))
    groups = per.join(overall, "source").withColumn("metric", F.lit("accuracy")) \
                .withColumn("overall", F.round(F.col("overall") * 1e6) / 1e6)
    reports = FR.report_json(groups, ["source"], ["lang"])
    return FR.flatten_reports(reports, "source")
