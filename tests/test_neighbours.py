"""Nearest-neighbour joins by pivots against brute force."""

import numpy as np
import pytest

from loomkit.operators import neighbours as N


def frames(spark, seed=1, n=400, d=3):
    rng = np.random.default_rng(seed)
    ref = np.concatenate([np.round(rng.normal(size=(n, d)), 1), np.repeat(rng.normal(size=(1, d)), n // 2, 0),
                          rng.normal(size=(n // 2, d)) * 0.01])  # ties, a third equal, a third close together
    asked = np.concatenate([rng.normal(size=(60, d)), np.repeat(ref[-1:], 30, 0), ref[:20]])
    ids = rng.permutation(len(ref)) + 5
    r = spark.createDataFrame([(int(i), x.tolist(), f"l{int(i) % 4}", float(i % 7)) for i, x in zip(ids, ref)],
                              "id long, v array<double>, label string, y double")
    q = spark.createDataFrame([(i, x.tolist(), "clash") for i, x in enumerate(asked)],
                              "key long, v array<double>, label string")
    return asked, ref, ids, r, q


def best(asked, ref, ids, k, p=2.0):
    out = []
    for x in asked:
        d = np.sqrt(((ref - x) ** 2).sum(1)) if p == 2 else (np.abs(ref - x) ** p).sum(1) ** (1 / p)
        out.append([(d[j], ids[j]) for j in np.lexsort((ids, d))[:k]])
    return out


@pytest.mark.parametrize("k,p,pivots", [(1, 2.0, 128), (7, 2.0, 5), (300, 1.0, 16)])
def test_nearest_rows_equal_brute_force(spark, k, p, pivots, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 64)  # several blocks and salts a cell
    asked, ref, ids, r, q = frames(spark)
    known, near = N.nearest_rows(q, "v", r, "v", "id", k, p, pivots)
    got = {}
    for row in near.join(known, "qid").collect():
        got.setdefault(tuple(row["x"]), []).append((row["rank"], row["id"], row["distance"]))
    for x, want in zip(asked, best(asked, ref, ids, k, p)):
        mine = sorted(got[tuple(x)])
        assert [m[1] for m in mine] == [w[1] for w in want]
        assert np.allclose([m[2] for m in mine], [w[0] for w in want])


def test_assignment_and_vote(spark):
    asked, ref, ids, r, q = frames(spark, seed=3)
    extra = spark.createDataFrame([(900, None, "none"), (901, [float("nan"), 0.0, 0.0], "nan")], q.schema)
    got = {x["key"]: x for x in N.assign_nearest(q.unionByName(extra), "v", r, "v", "label", "id").collect()}
    assert len(got) == len(asked) + 2 and got[900]["nearest_id"] is None and got[901]["cluster"] is None
    for i, w in enumerate(best(asked, ref, ids, 1)):
        assert got[i]["nearest_id"] == w[0][1] and got[i]["cluster"] == f"l{w[0][1] % 4}"
    for weights in ("uniform", "distance"):
        vote = {x["key"]: x["prediction"] for x in
                N.knn_predict(q, "v", r, "v", "label", "id", k=5, weights=weights).collect()}
        mean = {x["key"]: x["prediction"] for x in
                N.knn_predict(q, "v", r, "v", "y", "id", k=5, weights=weights, regression=True).collect()}
        for i, w in enumerate(best(asked, ref, ids, 5)):
            zero = any(d == 0 for d, _ in w)
            ws = [1.0 if weights == "uniform" else float(d == 0) if zero else 1 / d for d, _ in w]
            votes = {}
            for (_, j), weight in zip(w, ws):
                votes[f"l{j % 4}"] = votes.get(f"l{j % 4}", 0) + weight
            top = max(votes.values())
            assert vote[i] in {v for v, s in votes.items() if np.isclose(s, top)}
            assert np.isclose(mean[i], np.dot(ws, [j % 7 for _, j in w]) / sum(ws))


def test_text_ids_and_empty_reference(spark):
    r = spark.createDataFrame([("b", [1.0]), ("a", [3.0]), ("c", [1.0])], "id string, v array<double>") \
        .selectExpr("*", "id as label")
    q = spark.createDataFrame([(1, [2.0])], "key long, v array<double>")
    row = N.assign_nearest(q, "v", r, "v", "label", "id").first()
    assert (row["nearest_id"], row["distance"]) == ("a", 1.0)
    assert N.assign_nearest(q, "v", r.limit(0), "v", "label", "id").first()["nearest_id"] is None
    with pytest.raises(ValueError):
        N.nearest_rows(q, "v", r, "v", "id", 1, p=0.5)


def test_knn_is_a_catalog_model(spark):
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    from loomkit.operators.supervised import CATALOG, fit_model
    rows = spark.range(300).select(F.array((F.col("id") % 20).cast("double"), (F.col("id") % 3) * 9.0).alias("a"),
                                   (F.col("id") % 3).cast("double").alias("label"))
    df = rows.select(array_to_vector("a").alias("features"), "label")
    assert "knn" in CATALOG
    assert fit_model("knn", "multiclass", df, df, {"n_neighbors": 3})[1].first()["accuracy"] == 1.0
    assert fit_model("knn", "regression", df, df, {"weights": "distance"})[1].first()["r2"] > 0.99
