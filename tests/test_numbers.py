"""Operators outside the range of the test tables: tiny, huge, missing and broken values."""

import math
import warnings

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from loomkit.operators import ledger as LE
from loomkit.operators import logs as LG
from loomkit.operators import metrics as M
from loomkit.operators import profile as P
from loomkit.operators import series as SE
from loomkit.operators import splits as SP
from loomkit.operators import supervised as SV
from loomkit.operators import trees as TE
from loomkit.operators import transforms as TR
from loomkit.plans.search import sample_params


def test_scaling_and_profiles_of_tiny_and_huge_values(spark):
    for values in ([1e-12, 3e-12], [5e27, 7e27], [1e33, 3e33]):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        got = [r.x for r in TR.fit_transform_one(df, df, "x", "standard_scale").collect()]
        assert got == pytest.approx([-1.0, 1.0])
        r = P.profile_numeric_stats(df).first()
        assert (r["min"], r["max"]) == (values[0], values[1]) and r["mean"] == pytest.approx(sum(values) / 2)
    small = spark.createDataFrame([(1e-8,)] * 3, "x double")
    assert P.profile_numeric_stats(small).first()["mean"] == pytest.approx(1e-8)


def test_metrics_of_large_infinite_and_missing_errors(spark):
    df = spark.createDataFrame([(0.0, 1e14), (1.0, -1e14), (2.0, 2.0)], "y double, p double")
    r = M.regression(df, "y", "p").first()
    assert r.rmse == pytest.approx(math.sqrt(2e28 / 3), rel=1e-6) and r.mae == pytest.approx(2e14 / 3, rel=1e-6)
    odd = spark.createDataFrame([(0.0, float("inf")), (None, 1.0)], "y double, p double")
    assert M.regression(odd, "y", "p").first().mae == float("inf")


def test_auroc_of_billions_of_rows(spark):
    n = 5_000_000_000
    counts = spark.createDataFrame([(0.1, 0, n), (0.5, n // 2, n), (0.9, n, 0)], "score double, pos long, neg long")
    auc = M._auc_from_counts(counts, []).first().auc
    assert auc == pytest.approx((n * 2 * n + n / 2 * (n + n / 2)) / (1.5 * n * 2 * n))


def test_numeric_categories_keep_their_order(spark):
    df = spark.createDataFrame([(10,), (2,), (1,), (10,)], "c int")
    out = TR.fit_transform_one(df, df, "c", "ordinal", keep=["c"]).toDF("c", "code")
    assert {r.c: r.code for r in out.collect()} == {1: 0.0, 2: 1.0, 10: 2.0}


def test_bad_dates_are_null_not_errors(spark):
    df = spark.createDataFrame([("2024-03-05",), ("never",), ("2024-01-01 10:00:00",)], "d string")
    year = TR.date_parts(F.col("d"))
    got = [tuple(r) for r in df.select(year["year"], year["month"], year["hour"]).collect()]
    assert got == [(2024, 3, 0), (None, None, None), (2024, 1, 10)]


def test_log_lines_with_broken_json_and_empty_fields(spark):
    lines = ['{"x": 1 ERROR disk full', '{"level": "", "message": "", "msg": "said"}', '{"ts": "t", "level": "WARN", "message": "m"}',
             "  ", "plain WARN", '{"level": "DEBUG"}']
    df = spark.createDataFrame(list(enumerate(lines)), "i int, value string")
    got = {r.i: (r.ts, r.level, r.message) for r in LG.log_parse(df).collect()}
    assert got == {0: (None, "error", lines[0]), 1: (None, "info", "said"), 2: ("t", "warn", "m"), 4: (None, "warn", "plain WARN"),
                   5: (None, "debug", lines[5])}


def test_rows_without_a_key_are_spread_over_the_splits(spark):
    df = spark.range(300).select(F.lit(None).cast("long").alias("k"), "id")
    got = {r["split"]: r["count"] for r in SP.split_three_way(df, ["k"]).groupBy("split").count().collect()}
    assert set(got) == {"train", "val", "test"} and 150 < got["train"] < 260


def test_pages_and_searches_refuse_sizes_out_of_range(spark):
    df = spark.range(5)
    for page, size in ((1, 1000), (0, 10), (1, 0)):
        with pytest.raises(ValueError):
            LE.list_page(df, [F.col("id")], page, size)
    with pytest.raises(ValueError):
        sample_params({"a": {"type": "int", "low": 1, "high": 3}}, 800)


def test_schema_without_an_object_and_unions(spark):
    df = spark.createDataFrame([("1", "x", "a"), ("z", "y", "b"), (None, "y", "c")], "n string, s string, extra string")
    schema = {"properties": {"n": {"type": ["null", "integer"]}, "s": "odd", "new": {"default": 3}}, "required": ["n"]}
    ok, bad = P.apply_input_schema(df, schema)
    assert [tuple(r) for r in ok.collect()] == [(1, "x", 3)] and bad.count() == 2
    assert bad.first().reason == "missing or invalid: n"
    assert P.apply_input_schema(df, [])[0].columns == []


def _blobs(spark, kind):
    rows = [((i * 37 % 100) / 100.0, (i * 61 % 100) / 100.0) for i in range(200)]
    label = {"binary": lambda a, b: float((a - 0.5) ** 2 + (b - 0.5) ** 2 < 0.08),
             "regression": lambda a, b: 3.0 * a - b, "multiclass": lambda a, b: float(int(a * 3))}[kind]
    df = spark.createDataFrame([([a, b], label(a, b)) for a, b in rows], "x array<double>, label double")
    return df.select(array_to_vector("x").alias("features"), "label")


@pytest.mark.parametrize("name, kind, metric, least", [
    ("svm", "binary", "accuracy", 0.9), ("mlp", "multiclass", "accuracy", 0.8), ("naive_bayes", "multiclass", "accuracy", 0.9),
    ("ada_boost", "regression", "r2", 0.9), ("logistic", "multiclass", "auroc", 0.7)])
def test_catalog_defaults_fit(spark, name, kind, metric, least):
    df = _blobs(spark, kind)
    task = "regression" if kind == "regression" else "classification"
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        hp = {"n_estimators": 8} if name == "ada_boost" else {}
        _, mets, _ = SV.fit_model(name, task, df, df, hp)
    row = mets.first()
    assert row[metric] >= least
    if name in ("mlp", "logistic"):
        assert row["log_loss"] > 0 and row["auroc"] <= 1


def test_boosting_entries_start_from_their_own_defaults():
    assert {**TE.BOOST_DEFAULTS, **SV.SECOND_ORDER["xgboost"]}["max_depth"] == 6
    light = {**TE.BOOST_DEFAULTS, **SV.SECOND_ORDER["lightgbm"]}
    assert (light["n_estimators"], light["num_leaves"], light["min_child_samples"]) == (200, 31, 20)
    h = SV.build_estimator("hist_gbm", "regression", {}, 10, 1.0, 1.0, 2)
    assert (h.getMaxDepth(), h.getMaxIter(), h.getMaxBins()) == (3, 100, 255)
    with pytest.raises(ValueError, match="kernel"):
        SV.build_estimator("svm", "classification", {"kernel": "sigmoid"}, 10, 1.0, 1.0, 2)


@pytest.mark.parametrize("freq, days, after", [
    ("MS", ["2024-01-01", "2024-02-01", "2024-03-01", "2024-04-01"], "2024-05-01"),
    ("ME", ["2023-11-30", "2023-12-31", "2024-01-31", "2024-02-29"], "2024-03-31"),
    ("QS", ["2023-07-01", "2023-10-01", "2024-01-01", "2024-04-01"], "2024-07-01"),
    ("YS", ["2021-01-01", "2022-01-01", "2023-01-01", "2024-01-01", "2025-01-01"], "2026-01-01"),
    ("B", ["2024-03-07", "2024-03-08", "2024-03-11", "2024-03-12"], "2024-03-13"),
    ("B", ["2024-03-06", "2024-03-07", "2024-03-08", "2024-03-11", "2024-03-12", "2024-03-13", "2024-03-14", "2024-03-15"], "2024-03-18"),
    ("D", ["2024-03-01", "2024-03-02", "2024-03-03"], None)])
def test_calendar_frequencies(spark, freq, days, after):
    df = spark.createDataFrame([("s", d, 1.0) for d in days], "k string, d string, value double") \
        .select("k", F.col("d").cast("timestamp_ntz").alias("ts"), "value")
    r = SE.series_infer_freq(df, ["k"]).first()
    assert (r.freq, r.regular) == (freq, True)
    if after:
        out = SE.forecast_naive(df, ["k"], 1, "last", freq=freq).first()
        assert str(out.ts)[:10] == after
