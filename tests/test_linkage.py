"""Exact single linkage against brute force."""

import numpy as np
import pytest

from loomkit.operators import linkage as L
from loomkit.operators import neighbours as N
from loomkit.operators.clustering import cluster_agglomerative


def forest_by_hand(ids, x, limit=float("inf")):
    """Kruskal over all pairs, edges by distance, then the two ids."""
    pairs = sorted((float(np.sqrt(((x[a] - x[b]) ** 2).sum())), *sorted((int(ids[a]), int(ids[b]))))
                   for a in range(len(x)) for b in range(a))
    root = {int(i): int(i) for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    out = []
    for d, lo, hi in pairs:
        if d <= limit and find(lo) != find(hi):
            root[find(hi)] = find(lo)
            out.append((lo, hi, d))
    return out


def labels(ids, edges):
    root = {int(i): int(i) for i in ids}
    for _ in ids:
        for lo, hi, _d in edges:
            root[lo] = root[hi] = min(root[lo], root[hi])
    number = {r: i for i, r in enumerate(sorted(set(root.values())))}
    return {i: number[r] for i, r in root.items()}


def points(n, seed=2):
    """A third of the rows in one spot, a third on a grid (ties), the rest spread."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(size=(n // 3, 2)) * 0.01, np.round(rng.normal(size=(n // 3, 2)) * 4),
                        rng.normal(size=(n - 2 * (n // 3), 2)) * 3 + 2])
    x = np.unique(x, axis=0)
    return rng.permutation(len(x)) + 7, x


def test_forest_and_clusters_of_500_rows(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 64)  # several blocks and salts a cell
    ids, x = points(500)
    rows = [(int(i), v.tolist(), "clash") for i, v in zip(ids, x)]
    vectors = spark.createDataFrame([r[:2] for r in rows], "id long, x array<double>")
    want = forest_by_hand(ids, x)
    got = [tuple(r) for r in L.single_forest(vectors, pivots=24)[0].select("lo", "hi", "distance").collect()]
    assert len(got) == len(x) - 1
    # the unique forest under the order (distance, lo, hi)
    assert sorted(g[:2] for g in got) == sorted(w[:2] for w in want)
    assert np.isclose(sum(g[2] for g in got), sum(w[2] for w in want))


@pytest.mark.parametrize("k,threshold", [(6, None), (None, 0.8)])
def test_labels_repeats_and_missing_vectors(spark, k, threshold):
    ids, x = points(90, seed=5)
    rows = [(int(i), v.tolist(), -1) for i, v in zip(ids, x)]
    extra = [(5000, x[0].tolist(), -1), (5001, None, -1), (5002, [float("nan"), 0.0], -1), (None, [50.0, 50.0], -1)]
    df = spark.createDataFrame(rows + extra, "key long, v array<double>, root int")
    out = cluster_agglomerative(df, "v", k=k, linkage="single", id_col="key", threshold=threshold) \
        if k else L.cluster_single(df, "v", "key", threshold=threshold)
    got = {r["key"]: r["cluster"] for r in out.collect()}
    edges = forest_by_hand(ids, x, threshold or float("inf"))
    want = labels(ids, sorted(edges, key=lambda e: (e[2], e[0], e[1]))[:len(edges) - (k - 1 if k else 0)])
    assert {i: got[i] for i in want} == want
    assert got[5000] == want[int(ids[0])] and got[5001] is None and got[5002] is None and got[None] is None


def test_text_ids_few_rows_and_none(spark):
    df = spark.createDataFrame([("b", [0.0]), ("a", [9.0]), ("c", [1.0])], "key string, v array<double>")
    assert {r["key"]: r["cluster"] for r in L.cluster_single(df, "v", "key", k=2).collect()} == {"a": 0, "b": 1, "c": 1}
    assert {r["key"]: r["cluster"] for r in L.cluster_single(df, "v", "key", k=9).collect()} == {"a": 0, "b": 1, "c": 2}
    assert L.cluster_single(df.limit(0), "v", "key").count() == 0
    with pytest.raises(ValueError):
        cluster_agglomerative(df, "v", linkage="single")


def test_tables_written_do_not_grow_with_the_rows(spark, monkeypatch):
    """Trees of cells leave few edges to join: no rounds over all rows."""
    calls = []
    monkeypatch.setattr(L, "written", lambda df, f=L.written: (calls.append(1), f(df))[1])
    ids, x = points(500, seed=3)
    vectors = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "id long, x array<double>")
    got = [tuple(r) for r in L.single_forest(vectors, 1.5, pivots=12)[0].select("lo", "hi").collect()]
    assert sorted(got) == sorted(w[:2] for w in forest_by_hand(ids, x, 1.5))
    assert len(calls) <= 6


def test_many_edges_are_thinned_out_by_rounds(spark, monkeypatch):
    monkeypatch.setattr(L, "HELD", 40)
    ids, x = points(200, seed=4)
    vectors = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "id long, x array<double>")
    forest, trees = L.single_forest(vectors, 0.9, pivots=5)
    want = forest_by_hand(ids, x, 0.9)
    assert sorted(tuple(r) for r in forest.select("lo", "hi").collect()) == sorted(w[:2] for w in want)
    root = {r["id"]: r["root"] for r in trees.collect()}
    mine, label = {}, labels(ids, want)
    assert len(root) == len(ids)
    for i, r in root.items():
        assert mine.setdefault(r, label[i]) == label[i]
    assert len(mine) == len(set(label.values()))
