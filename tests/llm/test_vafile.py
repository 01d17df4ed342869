import numpy as np
from pyspark.sql import functions as F

from loomkit.llm import vafile
from loomkit.llm.vafile import bounds, exact_top_k

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k):
    good = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(np.float32(x)) for x in v):
            continue
        e = [int(np.floor(64 * float(np.float32(x)))) for x in v]
        good[i] = min(good.get(i, e), e)
    out = []
    for q in good:
        if q % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(good[q], e)), i) for i, e in good.items()
                       if i != q and len(e) == len(good[q]))
            out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s[:k])]
    return sorted(out)


def run(spark, rows, k=20, **how):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumns(
        {c: F.lit("clash") for c in ("id", "dim", "vec", "cid", "ids", "score")})
    out = exact_top_k(df, lambda i: i % 20 == 0, k, **how)
    assert dict(out.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    return sorted(tuple(r) for r in out.collect())


def vectors(n, dim, seed=0):
    r = np.random.default_rng(seed)
    return [[float(x) for x in r.normal(0, 0.3, dim)] for _ in range(n)]


def test_equals_brute_force_with_many_equal_vectors(spark):
    v = vectors(150, 12)
    rows = [(i, v[i % 90 if i > 100 else i]) for i in range(150)] + [(i, v[7]) for i in range(150, 260)]
    rows += [(300, None), (301, [None] + v[0][1:]), (302, [float("nan")] + v[0][1:]), (303, [float("inf")] + v[0][1:]),
             (None, v[0]), (20, v[20]), (400, v[0][:5]), (401, v[1][:5]), (404, []), (420, [])]
    assert run(spark, rows) == brute(rows, 20)


def test_small_blocks_and_few_bits(spark, monkeypatch):
    monkeypatch.setattr(vafile, "QUERY_BLOCK", 4)
    monkeypatch.setattr(vafile, "CELL_BLOCK", 32)
    rows = list(enumerate(vectors(200, 8, 1)))
    for bits in (1, 3, 8):
        assert run(spark, rows, k=5, bits=bits) == brute(rows, 5)


def test_fewer_rows_than_asked_and_empty_tables(spark):
    rows = list(enumerate(vectors(4, 3)))
    assert run(spark, rows) == brute(rows, 20) and len(run(spark, rows)) == 3
    assert run(spark, []) == [] and run(spark, [(20, [0.5])]) == []


def test_bounds_enclose_the_products():
    r = np.random.default_rng(2)
    x, q = r.integers(-90, 90, (50, 6)), r.integers(-90, 90, (20, 6))
    edges = -90 + np.arange(9)[:, None] * 181 // 8 * np.ones((1, 6), np.int64)
    cells = np.stack([np.searchsorted(edges[1:, j], x[:, j], side="right") for j in range(6)], 1).astype(np.uint8)
    lb, ub = bounds(q, cells, edges)
    assert (lb <= q @ x.T).all() and (q @ x.T <= ub).all()
