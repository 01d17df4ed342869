import numpy as np

import __spark_entry__ as E
from loomkit.operators import clustering as C


def planted(spark, n):
    """Groups of n and 2n rows, apart in the last 56 of 64 coordinates only; the first 8 are constant."""
    r = np.random.default_rng(3)
    x = np.hstack([np.zeros((3 * n, 8)), r.normal(size=(3 * n, 56))])
    x[:n, 8:] += 8
    return spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)],
                                 "vec_id long, embedding array<double>, label int")


def test_full_mixture_reads_every_coordinate(spark, tmp_path):
    planted(spark, 60).write.parquet(str(tmp_path / "embeddings.parquet"))
    out = E.queries()["cluster_gmm"](spark, str(tmp_path))
    assert out.columns == ["prediction", "count"]
    sizes = [r["count"] for r in out.collect()]
    sums = {0}
    for s in sizes:
        sums |= {a + s for a in sums}
    assert sum(sizes) == 180 and 60 in sums  # no component mixes the two groups


def test_fewer_rows_than_coordinates_and_null_vectors(spark):
    df = planted(spark, 10)
    df = df.unionByName(spark.createDataFrame([(99, None, 0)], df.schema))
    m = C.cluster_gmm(df, "embedding", k=2, covariance_type="full", max_iter=20)
    got = {r.vec_id: r.cluster for r in C.gmm_predict(df, "embedding", m).collect()}
    assert got.pop(99) is None
    assert len({got[i] for i in range(10)}) == len({got[i] for i in range(10, 30)}) == 1 and got[0] != got[29]
