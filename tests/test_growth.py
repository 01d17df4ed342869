"""Steps that once grew faster than their input, or were computed again and again."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

import __spark_entry__ as E
from loomkit.functions.prefix import dense_index
from loomkit.operators import neighbours as N
from loomkit.operators import reco_knn as K
from loomkit.operators import recommend as RC


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_only_raters_of_asked_items_are_summed(spark):
    # 300 users share item 0; each is asked for an item of one other user
    n = 300
    told = [(u, 0, 1.0 + u % 5) for u in range(n)] + [(u, 1000 + u, 2.0) for u in range(n)]
    rows = spark.createDataFrame(told, "x long, y long, v double")
    wanted = spark.createDataFrame([(u, (u + 1) % n) for u in range(n)], "a long, b long")
    sims = K._similar(rows, wanted, "cosine", 100.0)
    assert n <= sims.count() < 3 * n  # 90,000 pairs share the item
    assert wanted.join(sims, ["a", "b"]).count() == n
    heavy = wanted.unionByName(spark.range(n).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")))
    assert heavy.join(K._similar(rows, heavy, "cosine", 100.0), ["a", "b"]).distinct().where("a = 0").count() == n


def test_ratings_and_keys_are_computed_once(spark):
    from loomkit.plans.q_reco import ratings_split
    for part in ratings_split(spark, "/root/testdata/sf0.001"):
        assert "Join" not in _plan(part) and "Window" not in _plan(part)
    pairs = spark.createDataFrame([(3, 7, 1.0), (1, 9, 2.0), (3, 9, 4.0), (1, None, 1.0)],
                                  "user_id long, item_id long, rating double")
    joined = pairs.join(spark.range(10).withColumnRenamed("id", "user_id"), "user_id")
    users, items = RC.reco_index_ids(joined)
    for got, want in ((users, [(1, 0), (3, 1)]), (items, [(7, 0), (9, 1)])):
        assert "user_id = " not in _plan(got) and sorted(map(tuple, got.collect())) == want
    assert "Range" not in _plan(dense_index(spark.range(20), "id"))


def test_block_search_is_exact_and_bounded(monkeypatch):
    r = np.random.default_rng(5)
    for x, q in ((r.normal(size=(500, 8)), r.normal(size=(60, 8))),
                 (r.integers(0, 3, (500, 2)).astype(float), r.integers(0, 3, (60, 2)).astype(float)),
                 (1e6 + r.normal(size=(500, 4)) * 1e-3, 1e6 + r.normal(size=(60, 4)) * 1e-3),
                 (r.normal(size=(500, 3)) * 1e200, r.normal(size=(60, 3)))):
        ids, own, mine = np.arange(500) * 2, np.arange(500) % 3, np.arange(60) % 3
        whole = N.distances(q, x, 2)
        whole[mine[:, None] == own] = np.inf
        monkeypatch.setattr(N, "CELLS", 1600)
        for k in (1, 5, 40):
            order = np.argsort(whole, axis=1, kind="stable")[:, :k]
            bound = np.where(np.arange(60) % 2 == 0, np.inf, np.take_along_axis(whole, order, 1)[:, k // 2])
            part = pd.DataFrame({"x": list(q), "id": np.arange(60), "own": mine, "bound": bound})
            got = N._best(part, x, ids, own, k, 2.0, True)
            want = [(i, ids[j], whole[i, j]) for i in range(60) for j in order[i]
                    if whole[i, j] <= bound[i] and np.isfinite(whole[i, j])]
            assert list(got.itertuples(index=False, name=None)) == want
        monkeypatch.undo()


def test_far_cells_are_listed_not_multiplied():
    pivots = np.eye(4)
    pdf = pd.DataFrame({"qid": [1, 2], "x": [[1.0, 0, 0, 0], [0, 9.0, 0, 0]], "own": [0, 0], "cell": [0, 1],
                        "bound": [np.inf, 0.1]})
    out = pd.concat(N._second(pivots, 2.0, {c: (0.0, 1.0, 5) for c in range(4)})(iter([pdf])))
    assert out["qid"].tolist() == [1] and out["cells"].iloc[0].tolist() == [1, 2, 3]
    none = N._listed(pdf, np.zeros((2, 4), bool), np.arange(4))
    assert not len(none) and none["cells"].dtype == object  # a column of numbers is no column of lists to Arrow


def test_one_hot_index_is_read_without_an_array_as_wide_as_the_categories(spark):
    plan = _plan(E.queries()["tf_one_hot_sparse"](spark, "/root/testdata/sf0.001"))
    assert "unwrap_udt(" in plan and plan.count("UDF(") == 1  # the encoder's own, no second one that spreads its vector


def test_diagonal_sums_are_those_of_the_rows():
    from loomkit.operators import clustering as C
    r = np.random.default_rng(2)
    x, w, mu, var = r.normal(size=(40, 3)), np.array([0.3, 0.7]), r.normal(size=(2, 3)), np.array([[1.0, 2, 3], [0.5, 1, 2]])
    lp = np.array([[np.log(w[j]) - 0.5 * sum(np.log(2 * np.pi * var[j][i]) + (v[i] - mu[j][i]) ** 2 / var[j][i]
                                             for i in range(3)) for j in range(2)] for v in x])
    p = np.exp(lp)
    want = [np.log(p.sum(1)).sum()]
    for j in range(2):
        z = p[:, j] / p.sum(1)
        want += [z.sum(), *(z @ x), *(z @ (x * x))]
    parts = [pd.DataFrame({"x": list(x[a:a + 15])}) for a in range(0, 40, 15)]
    got = pd.concat(C._diag_sums(w, mu, var)(iter(parts)))
    assert np.allclose(got["v"], want)


def test_histograms_with_and_without_room(monkeypatch):
    from loomkit.operators import trees as TR
    r = np.random.default_rng(4)
    bins, y = r.integers(0, 5, (200, 3)), r.normal(size=200)
    forest = TR.Forest()
    forest.roots.append(forest.node([0.0], 0))
    forest.split(0, 1, 2, True, [0.0], [0.0])
    pdf = pd.DataFrame({"bins": list(bins), "m": [np.array([0.5])] * 200, "y": y})
    want = {}
    for b, t in zip(bins, y):
        node = 1 if b[1] <= 2 else 2
        for f in (0, 2):
            g, n = want.get((node, f, b[f]), (0.0, 0))
            want[node, f, b[f]] = g + 0.5 - t, n + 1
    for held in (10 ** 6, 1):
        monkeypatch.setattr(TR, "HELD", held)
        got = pd.concat(TR._histograms("regression", TR.Forest(), forest, [False, True, True], [[0, 2]], 6)(
            iter([pdf[:90], pdf[90:]]))).groupby(["node", "f", "b"]).sum()
        assert {k: n for k, n in got["n"].items()} == {k: v[1] for k, v in want.items()}
        assert all(abs(got["g"][k] - v[0]) < 1e-9 for k, v in want.items())


def test_levels_of_extra_trees_with_and_without_room(monkeypatch):
    from loomkit.operators import trees as TR
    r = np.random.default_rng(6)
    x, y = r.integers(0, 9, (300, 3)).astype(float), r.normal(size=300)
    x[::7, 2] = np.nan
    given = pd.DataFrame({"x": [*x[:-1], None], "z0": y})
    x[-1] = np.nan  # no vector: all missing
    forest = TR.Forest()
    forest.roots += [forest.node([0.0], 0), forest.node([0.0], 0)]
    forest.split(0, 2, 4.0, False, [0.0], [0.0])  # nodes 2 and 3; a missing value goes right
    drawn, cuts = {1: [0, 2], 2: [1, 2], 3: [0, 1]}, {1: [3.5, 4.5], 2: [None, 1.0], 3: [2.0, 0.5]}
    own = {1: np.ones(300, bool), 2: x[:, 2] <= 4, 3: ~(x[:, 2] <= 4)}
    chunks = [pd.concat(TR._packed(3, ["z0"])(iter([given[a:a + 100]]))) for a in (0, 100, 200)]
    for held in (10 ** 6, 1):
        monkeypatch.setattr(TR, "HELD", held)
        low = pd.concat(TR._Level(forest, drawn, 3).ranges(4)(iter(chunks)))
        got = low.groupby(["node", "i", "f"]).agg({"low": "min", "high": "max"}).to_dict("index")
        assert got == {(n, i, f): {"low": np.nanmin(x[own[n], f]), "high": np.nanmax(x[own[n], f])}
                       for n, fs in drawn.items() for i, f in enumerate(fs)}
        parts = pd.concat(TR._Level(forest, drawn, 3).sides(4, cuts)(iter(chunks)))
        assert len(parts) == (5 if held > 1 else 15)  # not one row per row, tree and feature
        got = parts.groupby(["node", "f", "cut"])[["n", "nl", "q", "ql", "z0", "lz0"]].sum()
        assert len(got) == 5
        for (n, f, c), s in got.iterrows():
            left = own[n] & (x[:, f] <= c)
            want = [own[n].sum(), left.sum(), (y[own[n]] ** 2).sum(), (y[left] ** 2).sum(), y[own[n]].sum(), y[left].sum()]
            assert np.allclose(s.to_numpy(), want)


def test_rows_are_scored_once_for_all_metrics(spark):
    from pyspark.ml.functions import array_to_vector
    from loomkit.operators import supervised as SV
    data = spark.range(200).select(array_to_vector(F.array(F.col("id").cast("double"))).alias("features"),
                                   (F.col("id") > 90).cast("double").alias("label"))
    asked = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        asked.add(1)
        return v

    val = data.withColumn("label", counted("label"))
    _model, mets, _ = SV.fit_model("logistic", "classification", data, val)
    assert mets.first()["accuracy"] > 0.9 and asked.value <= 200
