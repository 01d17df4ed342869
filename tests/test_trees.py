"""Tree ensembles from grouped sums: boosting against a brute-force learner,
leaf-wise growth against naive best-first growth, parameters that take effect,
missing values, random thresholds of extra trees, hot nodes and edge cases."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from loomkit.operators import trees as TR
from loomkit.operators.supervised import fit_model


def frame(spark, x, y):
    rows = [([float(v) for v in r], float(t)) for r, t in zip(x, y)]
    return spark.createDataFrame(rows, "x array<double>, label double") \
        .select(array_to_vector("x").alias("features"), "label")


def planted(n=400, seed=1):
    r = np.random.default_rng(seed)
    x = r.integers(0, 12, (n, 3)).astype(float)
    y = 3.0 * (x[:, 0] > 6) + 2.0 * (x[:, 1] > 3) * (x[:, 0] <= 6) + r.normal(0, 0.1, n)
    return x, y


def brute_boost(x, y, rounds, rate, lam, alpha, leaves, depth=None, least=1):
    """Squared-error boosting, best leaf first, every value a threshold."""
    soft = lambda g: np.sign(g) * max(abs(g) - alpha, 0.0)
    score = lambda g, n: soft(g) ** 2 / (n + lam)
    m = np.full(len(y), y.mean())
    for _ in range(rounds):
        g = m - y
        open_, done = [(np.arange(len(y)), 0)], []
        while True:
            found = []
            for i, (rows, level) in enumerate(open_):
                if depth is not None and level >= depth:
                    continue
                for f in range(x.shape[1]):
                    for t in np.unique(x[rows, f])[:-1]:
                        le = x[rows, f] <= t
                        if le.sum() < least or (~le).sum() < least:
                            continue
                        gl, gr = g[rows][le].sum(), g[rows][~le].sum()
                        gain = 0.5 * (score(gl, le.sum()) + score(gr, (~le).sum()) - score(gl + gr, len(rows)))
                        found.append((gain, -i, -f, -t))
            if not found or max(found)[0] <= 0 or len(open_) + len(done) >= leaves:
                break
            _gain, i, f, t = max(found)
            rows, level = open_.pop(-i)
            le = x[rows, -f] <= -t
            open_ += [(rows[le], level + 1), (rows[~le], level + 1)]
        for rows, _level in open_:
            m[rows] -= rate * soft(g[rows].sum()) / (len(rows) + lam)
    return m


@pytest.mark.parametrize("params,leaves,depth,least", [
    ({"max_depth": 2}, 4, 2, 1),
    ({"max_depth": -1, "num_leaves": 5, "min_child_samples": 20}, 5, None, 20),
    ({"max_depth": 3, "reg_alpha": 4.0, "reg_lambda": 0.5}, 8, 3, 1),
])
def test_boosting_equals_brute_force(spark, params, leaves, depth, least):
    x, y = planted()
    p = {"n_estimators": 3, "learning_rate": 0.5, **params}
    model = TR.fit_boosting(frame(spark, x, y), "regression", p)
    got = np.array([r["prediction"] for r in model.transform(frame(spark, x, y)).select("prediction").collect()])
    want = brute_boost(x, y, 3, 0.5, p.get("reg_lambda", 1.0), p.get("reg_alpha", 0.0), leaves, depth, least)
    assert np.allclose(np.sort(got), np.sort(want), atol=1e-8)


def test_more_rounds_than_one_checkpoint(spark):
    x, y = planted(200)
    model = TR.fit_boosting(frame(spark, x, y), "regression",
                            {"n_estimators": TR.CHECKPOINT_ROUNDS + 2, "learning_rate": 0.5, "max_depth": 1})
    got = np.array([r["prediction"] for r in model.transform(frame(spark, x, y)).select("prediction").collect()])
    want = brute_boost(x, y, TR.CHECKPOINT_ROUNDS + 2, 0.5, 1.0, 0.0, 2, 1)
    assert np.allclose(np.sort(got), np.sort(want), atol=1e-8)


def test_missing_values_take_the_better_side(spark):
    x = [[float("nan")]] * 50 + [[1.0]] * 50 + [[2.0]] * 50
    y = [5.0] * 50 + [5.0] * 50 + [0.0] * 50
    model = TR.fit_boosting(frame(spark, x, y), "regression",
                            {"n_estimators": 1, "learning_rate": 1.0, "max_depth": 1, "reg_lambda": 0.0})
    out = model.transform(frame(spark, [[float("nan")], [1.0], [2.0]], [0, 0, 0])).collect()
    assert [round(r["prediction"], 6) for r in out] == [5.0, 5.0, 0.0]


def test_only_missing_against_present(spark):
    x = [[float("nan")]] * 30 + [[float(i % 3)] for i in range(60)]
    y = [9.0] * 30 + [1.0] * 60
    model = TR.fit_boosting(frame(spark, x, y), "regression",
                            {"n_estimators": 1, "learning_rate": 1.0, "max_depth": 1, "reg_lambda": 0.0})
    out = model.transform(frame(spark, [[float("nan")], [0.0], [2.0], [7.0]], [0] * 4)).collect()
    assert [round(r["prediction"], 6) for r in out] == [9.0, 1.0, 1.0, 1.0]


def test_sampling_is_seeded_and_takes_effect(spark):
    x, y = planted()
    p = {"n_estimators": 2, "max_depth": 2}

    def used(**more):
        f = TR.fit_boosting(frame(spark, x, y), "regression", {**p, **more}).forest
        return f.feature, f.threshold, f.value

    assert used(subsample=0.5, seed=1) == used(subsample=0.5, seed=1)
    assert used(subsample=0.5, seed=1) != used(subsample=0.5, seed=2)
    per_tree = TR.fit_boosting(frame(spark, x, y), "regression", {**p, "colsample_bytree": 0.3}).forest
    for a, b in zip(per_tree.roots, [*per_tree.roots[1:], len(per_tree.feature)]):
        assert len({f for f in per_tree.feature[a:b] if f >= 0}) == 1  # one of three columns a tree


def test_classes(spark):
    r = np.random.default_rng(3)
    x = r.uniform(0, 1, (600, 2))
    three = (x[:, 0] > 0.5).astype(int) + (x[:, 1] > 0.5).astype(int)
    for y in (three, (three > 0).astype(int)):
        objective = "multiclass" if y.max() > 1 else "binary"
        out = TR.fit_boosting(frame(spark, x, y), objective, {"n_estimators": 8, "max_depth": 3, "learning_rate": 0.5}) \
            .transform(frame(spark, x, y))
        assert out.where("prediction = label").count() / 600 > 0.97
        total = F.aggregate(vector_to_array("probability"), F.lit(0.0), lambda a, v: a + v)
        assert out.where(F.abs(total - 1.0) < 1e-9).count() == 600


def test_catalog_reaches_the_learners(spark):
    x, y = planted()
    for name, depth in (("xgboost", 3), ("lightgbm", 3), ("extra_trees", 8)):  # random thresholds need more levels
        model, mets, _ = fit_model(name, "regression", frame(spark, x, y), frame(spark, x, y),
                                   {"n_estimators": 5, "learning_rate": 0.5, "max_depth": depth})
        assert isinstance(model, TR.ForestModel)
        assert mets.first()["r2"] > 0.9, name


def test_extra_trees_thresholds_differ_by_seed_and_lie_in_the_node(spark):
    x, y = planted()
    a = TR.fit_extra_trees(frame(spark, x, y), False, n_estimators=3, max_depth=3, seed=1)
    b = TR.fit_extra_trees(frame(spark, x, y), False, n_estimators=3, max_depth=3, seed=2)
    same = TR.fit_extra_trees(frame(spark, x, y), False, n_estimators=3, max_depth=3, seed=1)
    assert a.forest.threshold == same.forest.threshold != b.forest.threshold
    f = a.forest
    for root in f.roots:
        stack = [(root, np.arange(len(y)))]
        while stack:
            at, rows = stack.pop()
            assert f.value[at][0] + y.mean() == pytest.approx(y[rows].mean(), abs=1e-9)
            if f.feature[at] < 0:
                continue
            v = x[rows, f.feature[at]]
            assert v.min() <= f.threshold[at] < v.max()
            le = v <= f.threshold[at]
            stack += [(f.left[at], rows[le]), (f.left[at] + 1, rows[~le])]


def test_extra_trees_classify_until_pure(spark):
    r = np.random.default_rng(5)
    x = r.uniform(0, 1, (300, 4))
    y = (x[:, 0] > 0.5).astype(int) + (x[:, 1] > 0.7).astype(int)
    model = TR.fit_extra_trees(frame(spark, x, y), True, n_estimators=5, max_features="sqrt")
    out = model.transform(frame(spark, x, y))
    assert out.where("prediction = label").count() == 300  # distinct rows, grown until pure


def test_edge_cases(spark):
    flat = frame(spark, [[1.0], [1.0], [1.0]], [2.0, 4.0, 6.0])
    for model in (TR.fit_boosting(flat, "regression", {"n_estimators": 3}),
                  TR.fit_extra_trees(flat, False, n_estimators=2)):
        assert [r["prediction"] for r in model.transform(flat).collect()] == pytest.approx([4.0] * 3)
    some = flat.union(flat.withColumn("label", F.lit(None).cast("double")))
    assert TR.fit_boosting(some, "regression", {"n_estimators": 1}).base == [4.0]
    for fit in (lambda e: TR.fit_boosting(e, "regression"), lambda e: TR.fit_extra_trees(e, False)):
        with pytest.raises(ValueError):
            fit(flat.where("false"))
    with pytest.raises(ValueError):
        TR.fit_boosting(flat, "regression", {"max_depth": -1})
    with pytest.raises(ValueError):
        TR.fit_boosting(flat, "ranking")
