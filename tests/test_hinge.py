"""The wave classifier against ``LinearSVC`` on stored waves; rows that cannot be fitted."""

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.functions import array_to_vector

from loomkit.operators import hinge as H
from loomkit.operators import supervised as SV


def frame(spark, rows):
    return spark.createDataFrame(rows, "x array<double>, label double").select(array_to_vector("x").alias("features"), "label")


def planted(classes, n=300, seed=3):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 2))
    y = (np.hypot(*x.T) * classes / 2.2).astype(int).clip(0, classes - 1)
    y[r.random(n) < 0.1] = 0  # no perfect separation
    return [([float(v) for v in row], float(c)) for row, c in zip(x, y)]


def test_squares_are_those_of_cosines():
    r = np.random.default_rng(1)
    x, w, b = r.normal(size=(H.ROWS, 3)) * 20, r.normal(size=(3, 40)), r.uniform(0, 6, 40)
    t = H.turns(w, b)
    got = H.squares(np.column_stack([x, np.ones(len(x))]), t, H.space(t))
    assert np.abs(2 * got - 1 - np.cos(x @ w + b)).max() < 1e-11
    assert H.squares(np.ones((5, 4)), t, H.space(t)).shape == (5, 40)


@pytest.mark.parametrize("classes", [2, 3])
def test_fit_is_that_of_linear_svc_and_stores_no_waves(spark, monkeypatch, classes):
    rows = planted(classes)
    df = frame(spark, rows).coalesce(2).cache()
    waves = SV.RandomFourier(*SV.kernel_gamma(df, "scale"))
    svc = LinearSVC(maxIter=6, regParam=1.0 / len(rows), featuresCol="_rff")
    old = (svc if classes == 2 else OneVsRest(classifier=svc, featuresCol="_rff")).fit(waves.transform(df))
    told = {tuple(r["features"]): r["prediction"] for r in old.transform(waves.transform(df)).collect()}

    def stored(*_):
        raise AssertionError("waves of all rows")

    monkeypatch.setattr(SV.RandomFourier, "_transform", stored)
    monkeypatch.setattr(H, "STEPS", 6)
    new, mets, _ = SV.fit_model("svm", "classification", df, df, {"C": 1.0})
    got = {tuple(r["features"]): r["prediction"] for r in new.transform(df).collect()}
    assert got == told and len(set(got.values())) == classes
    assert mets.first()["accuracy"] > 0.6
    for i, m in enumerate([old] if classes == 2 else old.models):
        assert new.a[:, i] / 2 / waves.scale == pytest.approx(m.coefficients.toArray(), rel=1e-6, abs=1e-8)


def test_labels_and_vectors_that_cannot_be_fitted(spark):
    good = [([float(i), 1.0], float(i % 2)) for i in range(8)]
    for bad, said in ((([1.0, 1.0], None), "Null"), (([float("nan"), 1.0], 1.0), "NaN"), (([1.0, 1.0], 0.5), "Labels")):
        df = frame(spark, [*good, bad])
        with pytest.raises(Exception, match=said):
            H.fit_wave_svc(df, np.ones((2, 4)), np.zeros(4), 0.5, 0.1, 2)


def test_constant_features_leave_the_intercept(spark, monkeypatch):
    monkeypatch.setattr(H, "STEPS", 6)
    df = frame(spark, [([1.0, 2.0], float(i % 4 == 0)) for i in range(40)])
    model = H.fit_wave_svc(df, np.ones((2, 4)), np.zeros(4), 0.5, 0.1, 2)
    assert not model.a.any() and model.offset[0] < 0
    assert {r["prediction"] for r in model.transform(df).collect()} == {0.0}
