"""Time series preparation and forecasting on a panel of series.

Preparation (parse, de-duplicate by sum, resample with gap filling, frequency
inference, naive forecasts) is SQL: group-bys keyed by (series, time) and
bucketed prefix counts for positions, so no step sorts a whole series in one
task; frequency inference needs no ordering at all.

Model forecasters (theta, ETS, ARIMA, SARIMA) fit one series at a time in
``groupBy(series).applyInPandas`` with numpy; the unit of parallelism is the
series, and each group holds one aggregated series.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomkit.functions.exprs import epoch_seconds

# Text timestamp formats tried in order.
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy")

DAY_SECONDS = 86400


def parse_time(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return c.cast("timestamp_ntz")
    if isinstance(dtype, T.DateType):
        return c.cast("timestamp_ntz")
    s = c.cast("string")
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in TIME_FORMATS]) \
        .cast("timestamp_ntz")


def series_prepare(df: DataFrame, series_cols: list[str], time_col: str,
                   value_col: str) -> DataFrame:
    """``(series..., ts, value)``: parsed time, NULLs dropped, duplicates summed."""
    for c in (time_col, value_col, *series_cols):
        if c not in df.columns:
            raise ValueError(f"the series table lacks {c!r}")
    ts = parse_time(F.col(time_col), df.schema[time_col].dataType)
    v = F.col(value_col).cast("double")
    clean = df.select(*series_cols, ts.alias("ts"), F.nanvl(v, F.lit(None)).alias("value")) \
              .where(F.col("ts").isNotNull() & F.col("value").isNotNull())
    return clean.groupBy(*series_cols, "ts").agg(F.sum("value").alias("value"))


_MONDAY = "DATE'1970-01-05'"


def _business_day(ts: str) -> Column:
    """Number of a Monday-to-Friday day; a weekend counts as its Friday."""
    d = f"datediff({ts}, {_MONDAY})"
    return F.expr(f"floor({d} / 7) * 5 + least(pmod({d}, 7), 4)")


# Months between the points of a calendar frequency.
CALENDAR_MONTHS = {"MS": 1, "ME": 1, "QS": 3, "YS": 12}


def calendar_step(freq: str, ts: str = "last_ts", step: str = "step") -> Column:
    """The time ``step`` calendar steps after ``ts``; month ends stay month ends."""
    if freq in CALENDAR_MONTHS:
        day = f"add_months({ts}, {step} * {CALENDAR_MONTHS[freq]})"
        return F.expr(f"CAST({'last_day(' + day + ')' if freq == 'ME' else day} AS TIMESTAMP_NTZ)")
    if freq == "B":
        d = f"datediff({ts}, {_MONDAY})"
        n = f"(floor({d} / 7) * 5 + least(pmod({d}, 7), 4) + {step})"
        return F.expr(f"CAST(date_add({_MONDAY}, CAST(floor({n} / 5) * 7 + pmod({n}, 5) AS INT)) AS TIMESTAMP_NTZ)")
    raise ValueError(f"unknown calendar frequency {freq!r}")


def series_infer_freq(prepared: DataFrame, series_cols: list[str]) -> DataFrame:
    """Per series: ``freq`` label and ``regular`` flag.

    Regular spacing -> the spacing (``D``, ``h``, ``W`` or ``<n>s``); else
    consecutive year starts -> ``YS``, quarter starts -> ``QS``, month starts
    -> ``MS``, month ends -> ``ME``, business days -> ``B``; anything else ->
    ``D`` with ``regular = false`` (the caller resamples daily).

    No window: ``n`` distinct timestamps are evenly spaced exactly when the
    span is a multiple ``(n - 1) d`` of an integer step ``d`` and every
    timestamp sits on that grid.  Two aggregates per series, map-side combined.
    """
    e = epoch_seconds("ts")
    mo = F.year("ts") * 12 + F.month("ts")
    clock = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts") != 0
    g = prepared.groupBy(*series_cols).agg(
        F.count(F.lit(1)).alias("n"), F.min(e).alias("e0"), F.max(e).alias("e1"),
        F.min(mo).alias("m0"), F.max(mo).alias("m1"),
        F.min(_business_day("ts")).alias("b0"), F.max(_business_day("ts")).alias("b1"),
        F.max((F.weekday("ts") > 4).cast("int")).alias("weekend"), F.max(clock.cast("int")).alias("clock"),
        F.max((F.month("ts") % 3 != 1).cast("int")).alias("off_quarter"),
        F.max((F.month("ts") != 1).cast("int")).alias("off_year"),
        F.max((clock | (F.to_date("ts") != F.last_day("ts"))).cast("int")).alias("off_month_end"),
        F.max(((F.dayofmonth("ts") != 1) | (F.hour("ts") * 3600 + F.minute("ts") * 60
                                             + F.second("ts") != 0)).cast("int"))
        .alias("off_month_start"))
    step = F.when((F.col("n") > 1) & (((F.col("e1") - F.col("e0")) % (F.col("n") - 1)) == 0),
                  F.try_divide(F.col("e1") - F.col("e0"), F.col("n") - 1).cast("long"))
    g = g.withColumn("dt", step)
    on_grid = prepared.join(g.select(*series_cols, "e0", "dt"), series_cols) \
        .groupBy(*series_cols).agg(F.max(F.when(F.col("dt").isNull() | (F.col("dt") == 0), 1)
                                         .otherwise(((e - F.col("e0")) % F.col("dt") != 0)
                                                    .cast("int"))).alias("off_grid"))
    g = g.join(on_grid, series_cols)
    regular = (F.col("n") > 1) & (F.col("off_grid") == 0)
    monthly = (F.col("n") > 1) & (F.col("off_month_start") == 0) & \
        (F.col("m1") - F.col("m0") == F.col("n") - 1)
    starts = (F.col("n") > 1) & (F.col("off_month_start") == 0)
    months = F.col("m1") - F.col("m0")
    quarterly = starts & (F.col("off_quarter") == 0) & (months == 3 * (F.col("n") - 1))
    yearly = starts & (F.col("off_year") == 0) & (months == 12 * (F.col("n") - 1))
    month_ends = (F.col("n") > 1) & (F.col("off_month_end") == 0) & (months == F.col("n") - 1)
    business = (F.col("n") > 1) & (F.col("weekend") == 0) & (F.col("clock") == 0) & \
        (F.col("b1") - F.col("b0") == F.col("n") - 1)
    label = (F.when(regular & (F.col("dt") == DAY_SECONDS), "D")
              .when(regular & (F.col("dt") == 7 * DAY_SECONDS), "W")
              .when(regular & (F.col("dt") == 3600), "h")
              .when(regular, F.concat(F.col("dt").cast("string"), F.lit("s")))
              .when(yearly, "YS").when(quarterly, "QS").when(monthly, "MS")
              .when(month_ends, "ME").when(business, "B")
              .otherwise("D"))
    return g.select(*series_cols, label.alias("freq"), (regular | yearly | quarterly | monthly | month_ends | business).alias("regular"))


def series_resample(prepared: DataFrame, series_cols: list[str]) -> DataFrame:
    """Day floor, sum, and every missing day between first and last filled with 0.

    The calendar per series is generated from its (min, max) pair, so the
    work is proportional to the number of days, and the fill is a join on
    (series, day).
    """
    daily = prepared.groupBy(*series_cols, F.date_trunc("day", "ts").cast("timestamp_ntz")
                             .alias("ts")).agg(F.sum("value").alias("value"))
    span = daily.groupBy(*series_cols).agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    cal = span.select(*series_cols, F.explode(F.sequence(
        F.col("t0"), F.col("t1"), F.expr("INTERVAL 1 DAY"))).alias("ts"))
    return cal.join(daily, [*series_cols, "ts"], "left") \
              .withColumn("value", F.coalesce(F.col("value"), F.lit(0.0)))


def series_min_length(prepared: DataFrame, series_cols: list[str], horizon: int) -> DataFrame:
    """Per series: points, required ``max(h + 5, 20)`` and ``long_enough``."""
    need = max(horizon + 5, 20)
    return prepared.groupBy(*series_cols).agg(F.count(F.lit(1)).alias("n_points")) \
        .withColumn("required", F.lit(need)) \
        .withColumn("long_enough", F.col("n_points") >= need)


def _positions(df: DataFrame, series_cols: list[str]) -> DataFrame:
    """``pos`` (0-based, by time) and ``n`` per series without a per-series
    window: a bucketed prefix count keyed by (series, ts) and a grouped count,
    so one very long series is still cut into many tasks."""
    from loomkit.functions.prefix import prefix_sums

    pre = prefix_sums(df.withColumn("_one", F.lit(1)), "ts", ["_one"], prefix="_b",
                      group_cols=series_cols)
    n = df.groupBy(*series_cols).agg(F.count(F.lit(1)).alias("n"))
    return pre.withColumn("pos", F.col("_b_one").cast("long")).drop("_one", "_b_one") \
              .join(n, series_cols)


def forecast_emit(prepared: DataFrame, series_cols: list[str], horizon: int,
                  step_seconds: int = DAY_SECONDS, freq: str | None = None) -> DataFrame:
    """The next ``horizon`` timestamps after each series' last point, by fixed
    seconds or by a calendar frequency (``MS``, ``ME``, ``QS``, ``YS``, ``B``)."""
    if not 1 <= horizon <= 10000:
        raise ValueError("horizon must be in 1..10000")
    last = prepared.groupBy(*series_cols).agg(F.max("ts").alias("last_ts"))
    steps = last.select(*series_cols, "last_ts",
                        F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    if freq is not None:
        return steps.select(*series_cols, "step", calendar_step(freq).alias("ts"))
    return steps.select(*series_cols, "step", F.expr(
        f"timestampadd(SECOND, step * {int(step_seconds)}, last_ts)").alias("ts"))


def forecast_naive(train: DataFrame, series_cols: list[str], horizon: int,
                   strategy: str = "last", sp: int = 1,
                   step_seconds: int = DAY_SECONDS, freq: str | None = None) -> DataFrame:
    """Naive forecasts per series: ``last`` / ``mean`` (per season slot) / ``drift``.

    Output ``(series..., step, ts, value)``.  Pure SQL: positions by a window
    over the (aggregated) series, aggregates per series or season slot.
    """
    if strategy not in ("last", "mean", "drift"):
        raise ValueError(f"unknown naive strategy: {strategy!r}")
    p = _positions(train, series_cols)
    steps = forecast_emit(train, series_cols, horizon, step_seconds, freq)
    if strategy == "drift":
        ends = p.groupBy(*series_cols).agg(
            F.max_by("value", "pos").alias("last"), F.min_by("value", "pos").alias("first"),
            F.count(F.lit(1)).alias("n"))
        out = steps.join(ends, series_cols).withColumn(
            "value", F.col("last") + F.col("step") *
            F.when(F.col("n") > 1, (F.col("last") - F.col("first")) / (F.col("n") - 1))
             .otherwise(0.0))
        return out.select(*series_cols, "step", "ts", "value")
    # season slot of each training point counted back from the end: the
    # forecast step h uses slot (h - 1) % sp of the last season
    p = p.withColumn("slot", F.pmod(F.col("pos") - F.col("n"), F.lit(sp)))
    if strategy == "last":
        per = p.where(F.col("pos") >= F.col("n") - sp).groupBy(*series_cols, "slot") \
               .agg(F.max_by("value", "pos").alias("value"))
    else:
        per = p.groupBy(*series_cols, "slot").agg(F.avg("value").alias("value"))
    steps = steps.withColumn("slot", F.pmod(F.col("step") - 1, F.lit(sp)))
    return steps.join(per, [*series_cols, "slot"], "left").select(
        *series_cols, "step", "ts", "value")


# ---------------------------------------------------------------- model forecasters

def _ses(y: np.ndarray, alpha: float) -> tuple[float, float]:
    level = y[0]
    sse = 0.0
    for v in y[1:]:
        e = v - level
        sse += e * e
        level = level + alpha * e
    return level, sse


def _seasonal_index(y: np.ndarray, sp: int) -> np.ndarray:
    """Classical multiplicative seasonal index (centred moving average)."""
    n = len(y)
    if sp <= 1 or n < 2 * sp:
        return np.ones(sp if sp > 1 else 1)
    k = np.ones(sp) / sp
    trend = np.convolve(y, k, mode="same")
    ratio = np.where(trend != 0, y / np.where(trend == 0, 1, trend), 1.0)
    idx = np.array([np.nanmean(ratio[i::sp]) for i in range(sp)])
    idx = np.where(np.isfinite(idx) & (idx != 0), idx, 1.0)
    return idx / idx.mean()


def theta_forecast(y: np.ndarray, h: int, sp: int = 1, deseasonalize: bool = True) -> np.ndarray:
    """Theta method: SES forecast plus half the linear-trend slope (theta = 2)."""
    y = np.asarray(y, float)
    n = len(y)
    season = _seasonal_index(y, sp) if (deseasonalize and sp > 1) else None
    z = y / season[np.arange(n) % sp] if season is not None else y
    best = min(((a, _ses(z, a)) for a in np.linspace(0.05, 0.95, 19)), key=lambda t: t[1][1])
    alpha, (level, _) = best[0], best[1]
    t = np.arange(n)
    slope = np.polyfit(t, z, 1)[0] if n > 1 else 0.0
    steps = np.arange(1, h + 1)
    fc = level + 0.5 * slope * (steps - 1 + (1 - (1 - alpha) ** n) / alpha)
    if season is not None:
        fc = fc * season[(n + steps - 1) % sp]
    return fc


def ets_forecast(y: np.ndarray, h: int, trend: str | None = None, seasonal: str | None = None,
                 sp: int = 1, damped: bool = False) -> np.ndarray:
    """Additive/multiplicative Holt-Winters fitted by a coarse grid on SSE."""
    y = np.asarray(y, float)
    n = len(y)
    use_s = seasonal in ("add", "mul") and sp > 1 and n >= 2 * sp
    grid = np.linspace(0.1, 0.9, 5)

    def run(a, b, g, phi):
        level = y[:sp].mean() if use_s else y[0]
        tr = ((y[sp:2 * sp].mean() - y[:sp].mean()) / sp if use_s else
              (y[1] - y[0] if n > 1 else 0.0)) if trend else 0.0
        if use_s:
            s = (y[:sp] - level) if seasonal == "add" else y[:sp] / (level or 1.0)
            s = list(s)
        sse = 0.0
        for i in range(n):
            si = s[i % sp] if use_s else (0.0 if seasonal != "mul" else 1.0)
            base = level + phi * tr
            fit = base + si if (not use_s or seasonal == "add") else base * si
            e = y[i] - fit
            sse += e * e
            obs = y[i] - si if (not use_s or seasonal == "add") else y[i] / (si or 1.0)
            new_level = a * obs + (1 - a) * base
            if trend:
                tr = b * (new_level - level) + (1 - b) * phi * tr
            if use_s:
                s[i % sp] = (g * (y[i] - new_level) + (1 - g) * si if seasonal == "add"
                             else g * (y[i] / (new_level or 1.0)) + (1 - g) * si)
            level = new_level
        return sse, level, tr, (s if use_s else None)

    phi = 0.98 if damped else 1.0
    best = None
    for a in grid:
        for b in (grid if trend else [0.0]):
            for g in (grid if use_s else [0.0]):
                r = run(a, b, g, phi)
                if best is None or r[0] < best[0]:
                    best = r
    _, level, tr, s = best
    out = []
    for k in range(1, h + 1):
        damp = sum(phi ** j for j in range(1, k + 1)) if trend else 0.0
        base = level + damp * tr
        if s is not None:
            si = s[(n + k - 1) % sp]
            base = base + si if seasonal == "add" else base * si
        out.append(base)
    return np.array(out)


def arima_forecast(y: np.ndarray, h: int, p: int = 1, d: int = 0, q: int = 0,
                   P: int = 0, D: int = 0, Q: int = 0, s: int = 0) -> np.ndarray:
    """(S)ARIMA by conditional least squares: differencing, AR terms by OLS,
    MA terms by the Hannan-Rissanen two-step (long-AR residuals)."""
    y = np.asarray(y, float)
    hist = [y]
    z = y.copy()
    for _ in range(d):
        z = np.diff(z)
        hist.append(z)
    seas = []
    if s and D:
        for _ in range(D):
            seas.append(z.copy())
            z = z[s:] - z[:-s]
    lags = list(range(1, p + 1)) + ([s * i for i in range(1, P + 1)] if s else [])
    malags = list(range(1, q + 1)) + ([s * i for i in range(1, Q + 1)] if s else [])
    mu = z.mean() if len(z) else 0.0
    zc = z - mu
    resid = np.zeros_like(zc)
    if malags and len(zc) > 10:
        m = min(max(lags + malags + [1]) + 5, len(zc) // 3)
        X = np.column_stack([zc[m - k:len(zc) - k] for k in range(1, m + 1)])
        coef = np.linalg.lstsq(X, zc[m:], rcond=None)[0]
        resid[m:] = zc[m:] - X @ coef
    start = max(lags + malags + [0])
    cols = [zc[start - k:len(zc) - k] for k in lags] + [resid[start - k:len(zc) - k]
                                                         for k in malags]
    if cols and len(zc) - start > len(cols):
        X = np.column_stack(cols)
        beta = np.linalg.lstsq(X, zc[start:], rcond=None)[0]
    else:
        beta = np.zeros(len(cols))
    ar, ma = beta[:len(lags)], beta[len(lags):]
    zz, ee = list(zc), list(resid)
    for _ in range(h):
        v = sum(a * zz[-k] for a, k in zip(ar, lags) if k <= len(zz))
        v += sum(b * ee[-k] for b, k in zip(ma, malags) if k <= len(ee))
        zz.append(v)
        ee.append(0.0)
    fc = np.array(zz[len(zc):]) + mu
    for base in reversed(seas):  # undo seasonal differences
        ext = list(base)
        for v in fc:
            ext.append(v + ext[-s])
        fc = np.array(ext[len(base):])
    for lvl in reversed(hist[:-1]):  # undo ordinary differences
        fc = lvl[-1] + np.cumsum(fc)
    return fc


MODEL_FORECASTERS = {
    "theta": lambda y, h, hp: theta_forecast(y, h, int(hp.get("sp", 1)),
                                             bool(hp.get("deseasonalize", True))),
    "ets": lambda y, h, hp: ets_forecast(y, h, hp.get("trend"), hp.get("seasonal"),
                                         int(hp.get("sp", 1)), bool(hp.get("damped_trend"))),
    "arima": lambda y, h, hp: arima_forecast(y, h, int(hp.get("p", 1)), int(hp.get("d", 0)),
                                             int(hp.get("q", 0))),
    "sarimax": lambda y, h, hp: arima_forecast(
        y, h, int(hp.get("p", 1)), int(hp.get("d", 0)), int(hp.get("q", 0)),
        int(hp.get("P", 0)), int(hp.get("D", 0)), int(hp.get("Q", 0)), int(hp.get("s", 0))),
}


def forecast_model(train: DataFrame, series_cols: list[str], horizon: int, model: str,
                   hyperparams: dict | None = None, step_seconds: int = DAY_SECONDS
                   ) -> DataFrame:
    """Fit ``model`` per series (``applyInPandas``) and emit ``horizon`` steps.

    Each group is one aggregated series; the output schema is
    ``(series..., step, ts, value)``.
    """
    from loomkit.session import ship_package

    ship_package(train.sparkSession)
    hp = dict(hyperparams or {})
    fn = MODEL_FORECASTERS[model]
    key_fields = [train.schema[c] for c in series_cols]
    schema = T.StructType(key_fields + [T.StructField("step", T.IntegerType()),
                                        T.StructField("ts", T.TimestampNTZType()),
                                        T.StructField("value", T.DoubleType())])

    def per_series(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        y = pdf["value"].to_numpy(float)
        fc = fn(y, horizon, hp) if len(y) else np.full(horizon, np.nan)
        last = pd.Timestamp(pdf["ts"].iloc[-1])
        steps = np.arange(1, horizon + 1)
        out = pd.DataFrame({c: pdf[c].iloc[0] for c in series_cols}, index=range(horizon))
        out["step"] = steps.astype("int32")
        out["ts"] = [last + pd.Timedelta(seconds=int(k * step_seconds)) for k in steps]
        out["value"] = np.asarray(fc, float)
        return out

    return train.select(*series_cols, "ts", "value").groupBy(*series_cols) \
                .applyInPandas(per_series, schema)
