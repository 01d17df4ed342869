"""Neighbourhood predictions against plain loops, with a hot user and a hot item."""

import numpy as np
import pytest

from loomkit.operators import reco_knn as K


def plain(ratings, pairs, k, min_k, sim, user_based, shrinkage=100.0):
    told = {}
    for u, i, r in ratings:
        told.setdefault((u, i), []).append(r)
    told = {p: float(np.mean(v)) for p, v in told.items()}
    mean, low, high = np.mean(list(told.values())), min(told.values()), max(told.values())
    rows = {}
    for (u, i), r in told.items():
        x, y = (u, i) if user_based else (i, u)
        rows.setdefault(x, {})[y] = r
    res = rows
    if sim == "pearson_baseline":
        of_item, of_user = {}, {}
        for i in {p[1] for p in told}:
            d = [r - mean for p, r in told.items() if p[1] == i]
            of_item[i] = sum(d) / (len(d) + 10)
        for u in {p[0] for p in told}:
            d = [r - mean - of_item[p[1]] for p, r in told.items() if p[0] == u]
            of_user[u] = sum(d) / (len(d) + 15)
        res = {}
        for (u, i), r in told.items():
            x, y = (u, i) if user_based else (i, u)
            res.setdefault(x, {})[y] = r - mean - of_item[i] - of_user[u]

    def similar(a, b):
        if a == b:
            return 1.0
        ys = sorted(set(res[a]) & set(res[b]))
        p, q = np.array([res[a][y] for y in ys]), np.array([res[b][y] for y in ys])
        if not ys:
            return 0.0
        if sim == "msd":
            return 1 / (((p - q) ** 2).mean() + 1)
        if sim == "pearson":
            n = len(ys)
            den = np.sqrt((n * (p * p).sum() - p.sum() ** 2) * (n * (q * q).sum() - q.sum() ** 2))
            return (n * (p * q).sum() - p.sum() * q.sum()) / den if den else 0.0
        den = np.sqrt((p * p).sum() * (q * q).sum())
        v = (p * q).sum() / den if den else 0.0
        return v * (len(ys) - 1) / (len(ys) - 1 + shrinkage) if sim == "pearson_baseline" else v

    out = {}
    for u, i in pairs:
        x, y = (u, i) if user_based else (i, u)
        cand = [(similar(x, b), b, rows[b][y]) for b in rows if x in rows and y in rows[b]]
        best = [c for c in sorted(cand, key=lambda c: (-round(c[0], 12), c[1]))[:k] if c[0] > 1e-12]
        ok = len(best) >= max(1, min_k)
        p = sum(s * r for s, _, r in best) / sum(s for s, _, _ in best) if ok else mean
        out[u, i] = (len(best), min(max(p, low), high))
    return out


@pytest.mark.parametrize("sim,user_based,k,min_k", [("cosine", True, 40, 1), ("msd", False, 4, 2),
                                                    ("pearson", True, 6, 1), ("pearson_baseline", True, 8, 3)])
def test_equals_plain_loops(spark, sim, user_based, k, min_k, monkeypatch):
    monkeypatch.setattr(K, "POSTING", 16)  # the hot item's list is dealt over salts
    rng = np.random.default_rng(5)
    ratings = [(int(u), int(i), float(r)) for u, i, r in
               zip(rng.integers(0, 40, 400), rng.integers(0, 25, 400), rng.integers(1, 6, 400))]
    ratings += [(7, i, float(rng.integers(1, 6))) for i in range(25, 180)]  # a user with a third of the rows
    ratings += [(u, 3, float(rng.integers(1, 6))) for u in range(40)]       # an item that all have rated
    pairs = sorted({(int(u), int(i)) for u, i in zip(rng.integers(0, 42, 60), rng.integers(0, 28, 60))} | {(7, 3)})
    r = spark.createDataFrame(ratings + [(1, None, 2.0), (2, 2, None)], "user_id long, item_id long, rating double")
    q = spark.createDataFrame(pairs + pairs[:5], "user_id long, item_id long")
    got = {(x["user_id"], x["item_id"]): (x["neighbours"], x["prediction"]) for x in
           K.reco_knn(r, q, k=k, min_k=min_k, sim=sim, user_based=user_based).collect()}
    want = plain(ratings, pairs, k, min_k, sim, user_based)
    assert got.keys() == want.keys()
    for p in want:
        assert got[p][0] == want[p][0] and np.isclose(got[p][1], want[p][1]), p
