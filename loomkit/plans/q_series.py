"""Queries for series preparation and forecasting (survey 2.6): daily order
value per order priority (duplicate days summed, gap days filled with 0)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomkit.functions.exprs import r6
from loomkit.operators import metrics as M
from loomkit.operators import series as S
from loomkit.operators.splits import split_temporal
from loomkit.plans.registry import register
from loomkit.session import load_table

SER = ["o_orderpriority"]
H = 14

_PREP_SQL = """(SELECT o_orderpriority, o_orderdate AS ts, sum(o_totalprice) AS value
  FROM orders GROUP BY o_orderpriority, o_orderdate)"""
_RESAMPLED_SQL = f"""(WITH d AS (SELECT o_orderpriority, date_trunc('day', ts) AS ts, sum(value) AS v
    FROM {_PREP_SQL} GROUP BY o_orderpriority, date_trunc('day', ts)),
  s AS (SELECT o_orderpriority, min(ts) AS t0, max(ts) AS t1 FROM d GROUP BY o_orderpriority),
  c AS (SELECT o_orderpriority, unnest(generate_series(t0, t1, INTERVAL 1 DAY)) AS ts FROM s)
  SELECT c.o_orderpriority, CAST(c.ts AS TIMESTAMP) AS ts, coalesce(v, 0.0) AS value
  FROM c LEFT JOIN d ON c.o_orderpriority = d.o_orderpriority AND c.ts = d.ts)"""


def prepared(spark, sf):
    return S.series_prepare(load_table(spark, sf, "orders"), SER, "o_orderdate", "o_totalprice")


def resampled(spark, sf):
    return S.series_resample(prepared(spark, sf), SER)


@register("series_prepare", f"SELECT o_orderpriority, ts, round(value, 2) AS value FROM {_PREP_SQL}")
def q_series_prepare(spark, sf):
    return prepared(spark, sf).withColumn("value", r6("value", 2))


@register("series_resample", f"SELECT o_orderpriority, ts, round(value, 2) AS value FROM {_RESAMPLED_SQL}")
def q_series_resample(spark, sf):
    return resampled(spark, sf).withColumn("value", r6("value", 2))


def _freq_sql(src: str, kind: str) -> str:
    return f"""SELECT '{kind}' AS kind, o_orderpriority,
  CASE WHEN count(DISTINCT dt) = 1 AND min(dt) = 86400 THEN 'D'
       WHEN count(DISTINCT dt) = 1 AND min(dt) = 604800 THEN 'W'
       WHEN count(DISTINCT dt) = 1 AND min(dt) = 3600 THEN 'h'
       WHEN count(DISTINCT dt) = 1 THEN CAST(min(dt) AS VARCHAR) || 's' ELSE 'D' END AS freq,
  count(DISTINCT dt) = 1 AS regular
FROM (SELECT o_orderpriority, ts, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY o_orderpriority
        ORDER BY ts)) AS dt FROM {src}) GROUP BY o_orderpriority"""


@register("series_infer_freq", _freq_sql(_PREP_SQL, "raw") + " UNION ALL " +
          _freq_sql(_RESAMPLED_SQL, "resampled"))
def q_series_infer_freq(spark, sf):
    raw = S.series_infer_freq(prepared(spark, sf), SER).withColumn("kind", F.lit("raw"))
    res = S.series_infer_freq(resampled(spark, sf), SER).withColumn("kind", F.lit("resampled"))
    return raw.unionByName(res)


@register("series_min_length", f"""
SELECT o_orderpriority, count(*) AS n_points, {max(H + 5, 20)} AS required,
  count(*) >= {max(H + 5, 20)} AS long_enough FROM {_RESAMPLED_SQL} GROUP BY o_orderpriority""")
def q_series_min_length(spark, sf):
    return S.series_min_length(resampled(spark, sf), SER, H)


@register("forecast_emit", f"""
SELECT o_orderpriority, CAST(step AS INTEGER) AS step, last_ts + to_days(CAST(step AS INTEGER)) AS ts
FROM (SELECT o_orderpriority, max(ts) AS last_ts FROM {_PREP_SQL} GROUP BY o_orderpriority),
  range(1, {H} + 1) t(step)""")
def q_forecast_emit(spark, sf):
    return S.forecast_emit(prepared(spark, sf), SER, H)


_NAIVE_SQL = f"""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY ts) - 1 AS pos,
             count(*) OVER (PARTITION BY o_orderpriority) AS n FROM {_RESAMPLED_SQL}),
e AS (SELECT o_orderpriority, max(ts) AS last_ts, arg_max(value, pos) AS last, arg_min(value, pos) AS first,
        count(*) AS n FROM p GROUP BY o_orderpriority),
st AS (SELECT o_orderpriority, CAST(step AS INTEGER) AS step, last_ts + to_days(CAST(step AS INTEGER)) AS ts,
         last, first, n FROM e, range(1, 8) t(step)),
slot_mean AS (SELECT o_orderpriority, ((pos - n) % 7 + 7) % 7 AS slot,
         CAST(sum(CAST(value AS DECIMAL(38,10))) AS DOUBLE) / count(*) AS v FROM p
         GROUP BY o_orderpriority, ((pos - n) % 7 + 7) % 7)
SELECT o_orderpriority, 'last' AS strategy, step, ts, round(last, 4) AS value FROM st
UNION ALL
SELECT o_orderpriority, 'drift', step, ts,
  round(last + step * CASE WHEN n > 1 THEN (last - first) / (n - 1) ELSE 0.0 END, 4) FROM st
UNION ALL
SELECT st.o_orderpriority, 'mean_sp7', step, ts, round(v, 4) FROM st JOIN slot_mean m
  ON st.o_orderpriority = m.o_orderpriority AND m.slot = (step - 1) % 7"""


@register("forecast_naive", _NAIVE_SQL)
def q_forecast_naive(spark, sf):
    r = resampled(spark, sf)
    out = None
    for name, strat, sp in [("last", "last", 1), ("drift", "drift", 1), ("mean_sp7", "mean", 7)]:
        f = S.forecast_naive(r, SER, 7, strat, sp).withColumn("strategy", F.lit(name))
        out = f if out is None else out.unionByName(f)
    return out.withColumn("value", r6("value", 4))


@register("metric_forecast", f"""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY ts DESC) AS back
           FROM {_RESAMPLED_SQL}),
last AS (SELECT o_orderpriority, arg_max(value, ts) AS f FROM p WHERE back > {H} GROUP BY o_orderpriority),
j AS (SELECT p.o_orderpriority, value AS a, f FROM p JOIN last USING (o_orderpriority) WHERE back <= {H})
SELECT o_orderpriority,
  round(CAST(sum(CAST(abs(a - f) AS DECIMAL(38,10))) AS DOUBLE) / count(*), 4) AS mae,
  round(sqrt(CAST(sum(CAST((a - f) * (a - f) AS DECIMAL(38,10))) AS DOUBLE) / count(*)), 4) AS rmse,
  round(100.0 * avg(abs(a - f) / CASE WHEN (abs(a) + abs(f)) / 2.0 = 0 THEN 1e-12
        ELSE (abs(a) + abs(f)) / 2.0 END), 6) AS smape
FROM j GROUP BY o_orderpriority""", digits={"mae": 4, "rmse": 4})
def q_metric_forecast(spark, sf):
    r = split_temporal(resampled(spark, sf), SER, ["ts"], H)
    train = r.where(F.col("split") == "train").drop("split")
    val = r.where(F.col("split") == "val").select(*SER, "ts", F.col("value").alias("actual"))
    fc = S.forecast_naive(train, SER, H, "last")
    j = val.join(fc.select(*SER, "ts", F.col("value").alias("pred")), [*SER, "ts"])
    return M.forecast(j, SER, "actual", "pred")


def _model_query(model, hp):
    def q(spark, sf):
        r = split_temporal(resampled(spark, sf), SER, ["ts"], H)
        train = r.where(F.col("split") == "train").drop("split")
        val = r.where(F.col("split") == "val").select(*SER, "ts", F.col("value").alias("actual"))
        fc = S.forecast_model(train, SER, H, model, hp)
        j = val.join(fc.select(*SER, "ts", F.col("value").alias("pred")), [*SER, "ts"])
        return M.forecast(j, SER, "actual", "pred").withColumn("model", F.lit(model))
    return q


# model forecasters are fits: rows-only in the driver, unit-tested on planted series
register("forecast_theta")(_model_query("theta", {"sp": 7}))
register("forecast_ets")(_model_query("ets", {"trend": "add", "seasonal": "add", "sp": 7}))
register("forecast_arima")(_model_query("arima", {"p": 2, "d": 1, "q": 1}))
register("forecast_sarimax")(_model_query("sarimax", {"p": 1, "d": 0, "q": 1, "P": 1, "D": 1,
                                                      "Q": 0, "s": 7}))
