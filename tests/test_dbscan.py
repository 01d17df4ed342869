"""DBSCAN by cells against brute force, and components against union-find."""

import numpy as np
import pytest

from loomkit.functions.graph import components
from loomkit.operators.dbscan import cluster_dbscan


def brute(x, ids, eps, least, metric="euclidean"):
    diff = x[:, None, :] - x[None, :, :]
    near = np.abs(diff).sum(-1) if metric == "manhattan" else np.sqrt((diff ** 2).sum(-1))
    if metric == "cosine":
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        near = ((unit[:, None, :] - unit[None, :, :]) ** 2).sum(-1) / 2
    within = near <= eps
    core = within.sum(1) >= least
    label = np.full(len(x), -1)
    number = 0
    for i in np.argsort(ids):
        if not core[i] or label[i] >= 0:
            continue
        todo = [i]
        label[i] = number
        while todo:
            j = todo.pop()
            for k in np.flatnonzero(within[j] & core & (label < 0)):
                label[k] = number
                todo.append(k)
        number += 1
    for i in np.flatnonzero(~core):
        best = [(near[i, j], label[j]) for j in np.flatnonzero(within[i] & core)]
        label[i] = min(best)[1] if best else -1
    return {int(a): (int(b), bool(c)) for a, b, c in zip(ids, label, core)}


@pytest.mark.parametrize("d,eps,least,seed", [(2, 0.6, 5, 1), (1, 0.02, 4, 2), (3, 0.9, 6, 3), (5, 1.8, 4, 4)])
def test_equals_brute_force(spark, d, eps, least, seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(size=(120, d)) * 2, rng.normal(size=(80, d)) * 0.05 + 1,  # a hot spot
                        np.repeat(rng.normal(size=(3, d)), 10, 0), np.round(rng.normal(size=(60, d)), 1)])
    ids = rng.permutation(len(x)) * 3 - 50
    df = spark.createDataFrame([(int(i), [float(v) for v in r], "clash") for i, r in zip(ids, x)],
                               "key long, v array<double>, cluster string")
    got = {r["key"]: (r["cluster"], r["core"]) for r in cluster_dbscan(df, "v", "key", eps, least).collect()}
    want = brute(x, ids, eps, least)
    assert got == want
    assert len({c for c, _ in want.values()}) > 1 and (d > 3 or any(not k and c >= 0 for c, k in want.values()))


@pytest.mark.parametrize("metric,eps", [("manhattan", 0.7), ("cosine", 0.0031)])
def test_other_metrics(spark, metric, eps):
    x = np.random.default_rng(6).normal(size=(150, 2))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "key long, v array<double>")
    got = {r["key"]: (r["cluster"], r["core"]) for r in cluster_dbscan(df, "v", "key", eps, 4, metric).collect()}
    assert got == brute(x, np.arange(len(x)), eps, 4, metric) and len(set(got.values())) > 2


def test_two_hot_cells_a_gap_apart(spark):
    """Cells side by side with a third of the rows each, just within and just beyond eps."""
    rng = np.random.default_rng(9)
    for gap, clusters in ((0.999, 1), (1.001, 2)):
        a = rng.uniform(0, 0.3, size=(3000, 2))
        b = rng.uniform(0, 0.3, size=(3000, 2)) + [0.3 + gap, 0]
        a[0], b[0] = [0.3, 0.15], [0.3 + gap, 0.15]
        x = np.concatenate([a, b])
        df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
        out = cluster_dbscan(df, "v", "id", 1.0, 5)
        assert out.select("cluster").distinct().count() == clusters
        assert out.where("core").count() == len(x)


def test_rows_without_a_point_are_noise(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, [0.0]), (2, None), (3, [nan]), (4, [inf]), (5, [0.1]), (6, [None]), (7, [9.0])],
                               "id long, v array<double>")
    got = {r["id"]: (r["cluster"], r["core"]) for r in cluster_dbscan(df, "v", "id", 0.5, 2).collect()}
    assert got == {1: (0, True), 5: (0, True), **{i: (-1, False) for i in (2, 3, 4, 6, 7)}}
    assert cluster_dbscan(df.where("id = 2"), "v", "id").collect()[0]["cluster"] == -1
    assert cluster_dbscan(df.limit(0), "v", "id").count() == 0
    with pytest.raises(ValueError):
        cluster_dbscan(df, "v", "id", eps=0)


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, size=(260, 2))] + [(i, i + 1) for i in range(500, 560)]
    edges += [(700, i) for i in range(701, 900)]  # a hub
    up = {n: n for e in edges for n in e}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    got = {r["node"]: r["component"] for r in
           components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for e in edges for n in e if e[0] != e[1]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
