"""What the tree learners write and scan."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector

from loomkit.operators import trees as TR


def frame(spark, n=3000, d=4):
    r = np.random.default_rng(3)
    x = r.integers(0, 40, (n, d)).astype(float)
    y = (x[:, 0] > 20) * 1.0 + (x[:, 1] > 30)
    rows = [(v.tolist(), float(t)) for v, t in zip(x, y)]
    return spark.createDataFrame(rows, "x array<double>, label double").select(
        array_to_vector("x").alias("features"), "label")


def test_extra_trees_write_plain_rows(spark, monkeypatch):
    """No value of the written table holds a batch: readers take thousands of values at once."""
    kept = []
    monkeypatch.setattr(TR, "written", lambda df, f=TR.written: (kept.append(f(df)), kept[-1])[1])
    TR.fit_extra_trees(frame(spark), True, n_estimators=2, max_depth=2)
    assert kept and all(k.count() == 3000 for k in kept)


@pytest.mark.parametrize("objective,k", [("regression", 1), ("binary", 1), ("multiclass", 3)])
@pytest.mark.parametrize("held", [10 ** 6, 1])
def test_histograms_of_rows_as_bytes(monkeypatch, objective, k, held):
    """Packed rows, trees still to be added, missing bins and columns of a tree: against sums row by row."""
    r = np.random.default_rng(5)
    n, d, width = 300, 3, 7
    bins, m = r.integers(0, 6, (n, d)).astype(np.int32), r.normal(size=(n, k))
    y = r.integers(0, max(2, k), n).astype(float)
    pending = TR.Forest()
    for t in range(k):
        root = pending.node([0.0] * k, 0)
        pending.roots.append(root)
        low, high = [0.0] * k, [0.0] * k
        low[t], high[t] = 0.3, -0.2
        pending.split(root, t % d, 2, t == 0, low, high)
    forest = TR.Forest()
    for t in range(k):
        forest.roots.append(forest.node([0.0], 0))
    is_open, columns = [True] * k, [None if t == 0 else [0, 2] for t in range(k)]
    if k == 1:
        forest.split(0, 1, 3, False, [0.0], [0.0])
        is_open = [False, True, True]
    monkeypatch.setattr(TR, "HELD", held)
    pdf = pd.DataFrame({"bins": TR._as_bytes(bins), "m": TR._as_bytes(m), "y": y})
    got = pd.concat(TR._histograms(objective, pending, forest, is_open, columns, width)(
        iter([pdf[:110], pdf[:0], pdf[110:]]))).groupby(["node", "f", "b"]).sum()
    now = m.copy()
    for t in range(k):
        v = bins[:, t % d]
        now[:, t] += np.where((v <= 2) if t == 0 else (v <= 2) & (v > 0), 0.3, -0.2)
    g, h = TR._gradients(objective, now, y)
    want = {}
    for i in range(n):
        for t in range(k):
            node = t if k > 1 else (1 if 0 < bins[i, 1] <= 3 else 2)
            for f in range(d) if columns[t] is None else columns[t]:
                s = want.setdefault((node, f, int(bins[i, f])), np.zeros(3))
                s += g[i, t], h[i, t], 1
    assert set(got.index) == set(want)
    for key, s in want.items():
        assert np.allclose(got.loc[key, ["g", "h", "n"]].to_numpy(float), s)


def test_margins_move_by_the_pending_trees(spark, monkeypatch):
    """Margins stored every second round give the trees that margins made anew give."""
    data = frame(spark, 600)
    asked = {"n_estimators": 5, "max_depth": 3}
    whole = TR.fit_boosting(data, "regression", asked).forest
    monkeypatch.setattr(TR, "CHECKPOINT_ROUNDS", 2)
    parts = TR.fit_boosting(data, "regression", asked).forest
    assert parts.feature == whole.feature and np.allclose(parts.threshold, whole.threshold)
    assert np.allclose([v[0] for v in parts.value], [v[0] for v in whole.value])
