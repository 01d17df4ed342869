"""Category encoders: missing values, dictionaries of any size, bad dates."""

import math

import pytest
from pyspark.sql import functions as F

from loomkit.operators import transforms as TF
from loomkit.plans.features import build_feature_pipeline


def frame(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id int, c {kind}")


def fitted(train, op, params):
    o = TF.ColumnOp("c", op, params, key=f"0_{op}_c")
    return TF.fit_ops(train, [o])[0]


def hot(df, o):
    out = TF.apply_ops(df, [o], keep=["id"]).orderBy("id").collect()
    if o.dictionary is None:
        return [[r[i] for i in range(1, len(r))] for r in out]
    return [list(r["c_onehot"].toArray()) for r in out]


@pytest.mark.parametrize("sparse", [False, True])
def test_missing_is_the_last_category(spark, sparse):
    train = frame(spark, ["b", None, "a", "a", None])
    o = fitted(train, "one_hot", {"sparse": sparse})
    new = frame(spark, ["a", "b", None, "z"])
    assert o.width == 3 and hot(new, o) == [[1, 0, 0], [0, 1, 0], [0, 0, 1], [0, 0, 0]]
    if not sparse:
        assert [n for n, _ in o.outputs()] == ["c_a", "c_b", "c_nan"]
    o = fitted(frame(spark, ["b", "a"]), "one_hot", {"sparse": sparse})  # not missing in training: unknown
    assert hot(new, o) == [[1, 0], [0, 1], [0, 0], [0, 0]]


@pytest.mark.parametrize("sparse", [False, True])
def test_ordinal_codes(spark, sparse):
    codes = lambda o, df: [r["c"] for r in TF.apply_ops(df, [o], keep=["id"]).orderBy("id").collect()]
    train, new = frame(spark, ["b", None, "a"]), frame(spark, ["a", "b", None, "z"])
    got = codes(fitted(train, "ordinal", {"sparse": sparse}), new)
    assert got[:2] == [0.0, 1.0] and math.isnan(got[2]) and got[3] == -1.0
    assert codes(fitted(train, "label", {"sparse": sparse, "encoded_missing_value": 9, "unknown_value": 7}), new) \
        == [0.0, 1.0, 9.0, 7.0]
    assert codes(fitted(frame(spark, ["b", "a"]), "ordinal", {"sparse": sparse}), new) == [0.0, 1.0, -1.0, -1.0]
    nan = float("nan")
    numbers = fitted(frame(spark, [10.0, 9.0, nan, None], "double"), "ordinal", {"sparse": sparse})
    got = codes(numbers, frame(spark, [9.0, 10.0, nan, None, 3.0], "double"))
    assert got[:2] == [0.0, 1.0] and math.isnan(got[2]) and math.isnan(got[3]) and got[4] == -1.0


@pytest.mark.parametrize("sparse", [False, True])
def test_rare_values_are_pooled(spark, sparse):
    train = frame(spark, ["a"] * 5 + ["b"] * 4 + ["x", "y", None])
    o = fitted(train, "one_hot", {"sparse": sparse, "min_frequency": 3})
    assert hot(frame(spark, ["a", "b", "x", None, "z"]), o) \
        == [[1, 0, 0], [0, 1, 0], [0, 0, 1], [0, 0, 1], [0, 0, 0]]


def test_a_hundred_thousand_categories(spark):
    n = 100_000
    train = spark.range(3 * n).select(F.col("id").cast("int").alias("id"), F.when(
        F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.format_string("k%06d", F.col("id") % n)).alias("c"))
    assert train.select("c").distinct().count() == n + 1
    o = fitted(train, "one_hot", {})
    assert o.dictionary is not None and o.width == n + 1
    out = TF.apply_ops(train.where("id < 20"), [o], keep=["id"]).collect()
    # "hot" sorts first, then the keys in order
    assert {r["id"]: list(r["c_onehot"].indices) for r in out} == {i: [0 if i % 3 == 0 else i + 1] for i in range(20)}
    assert out[0]["c_onehot"].size == n + 1


def test_a_plan_with_a_large_column_assembles(spark):
    train = spark.range(1000).select(F.col("id").alias("x"), F.concat(F.lit("u"), F.col("id") % 500).alias("who"),
                                     F.when(F.col("id") % 2 == 0, "e").alias("half"))
    model = build_feature_pipeline(train, [{"column": "who", "op": "ordinal", "params": {}}],
                                   {"x": "numeric", "who": "categorical", "half": "categorical"})
    assert model._transform(train).first()["features"].size == 4
    model = build_feature_pipeline(train, [], {"x": "numeric", "who": "categorical", "half": "categorical"})
    rows = model._transform(train).collect()
    assert all(r["features"].size == 1 + 500 + 2 for r in rows) and rows[3]["features"].numNonzeros() == 3


def test_bad_dates_are_missing(spark):
    train = frame(spark, ["2024-03-01", "garbage", "2024-03-03 10:00:00", None, "2024-03-05"])
    o = fitted(train, "date_features", {})
    out = TF.apply_ops(train, [o], keep=["id"]).orderBy("id").collect()
    assert "c_hour" in out[0].asDict()
    assert out[1]["c_day"] == out[3]["c_day"] == out[2]["c_day"]  # the median
