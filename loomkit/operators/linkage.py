"""Exact single-linkage clusters from a minimum spanning forest.

Vectors fall into cells around pivots (see ``neighbours``).  An edge of the
forest is one of the forest of any set that holds both its ends, so it is
among the edges of a cell's own tree or, where its ends lie in two cells, of a
tree over those rows of the two that may be near enough.  How near is known
from the trees of the cells: rows of two cells are joined by steps of a known
length, and no edge between them is longer.  The edges so found, not many more
than the vectors, are thinned out by Borůvka rounds until few enough are left
for one task.  Edges are ordered by distance, then the two ids, so the forest
is unique.  Nothing but pivots and a row per cell reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomkit.functions.graph import components
from loomkit.functions.prefix import dense_index
from loomkit.operators.neighbours import _finite, _listed, _matrix, _placed, distances
from loomkit.session import ship_package, written

CELL, CELLS = 2048, 1024  # vectors of a cell, about; cells at most
HELD = 1_000_000  # edges that one task joins into trees at the end

_EDGE = "lo long, hi long, distance double"


def _tree(x: np.ndarray, p: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prim's minimum spanning tree of rows in the order of their ids: its edges as positions, and their lengths."""
    n, z = len(x), x.T
    a, b, length = np.empty(n - 1, int), np.empty(n - 1, int), np.empty(n - 1)
    rest, near, far, y = np.arange(1, n), np.zeros(n - 1, int), np.full(n - 1, np.inf), z[:, 1:].copy()
    at = 0
    for i in range(n - 1):
        d = y - z[:, at, None]
        d = np.sqrt((d * d).sum(0)) if p == 2 else (np.abs(d) ** p).sum(0) ** (1 / p)
        # of equally long edges that end in one row, that from the smaller id comes first
        better = (d < far) | ((d == far) & (at < near))
        near[better], far[better] = at, d[better]
        best = int(far.argmin())
        ties = np.flatnonzero(far == far[best])
        if len(ties) > 1:
            low, high = np.minimum(near[ties], rest[ties]), np.maximum(near[ties], rest[ties])
            best = int(ties[np.lexsort((high, low))[0]])
        a[i], b[i], length[i], at = near[best], rest[best], far[best], int(rest[best])
        for v in (rest, near, far):
            v[best] = v[-1]
        y[:, best] = y[:, -1]
        rest, near, far, y = rest[:-1], near[:-1], far[:-1], y[:, :-1]
    return a, b, length


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of each key, by id; equal keys come one after the other."""
    held = []
    for pdf in batches:
        ids = pdf[keys].to_numpy()
        cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1), len(ids)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            if held and tuple(held[-1][keys].iloc[-1]) != tuple(ids[a]):
                yield pd.concat(held).sort_values("rid")
                held = []
            held.append(pdf.iloc[a:b])
    if held:
        yield pd.concat(held).sort_values("rid")


def _told(ids: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"lo": ids[np.minimum(a, b)], "hi": ids[np.maximum(a, b)], "distance": length})


def _inside(pivots: np.ndarray, p: float, limit: float):
    """Per cell the edges of its own tree, and a row with its longest edge, its smallest and largest
    distance to the pivot, and its smallest distance to every pivot."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _runs(batches, ["cell"]):
            x, cell = _matrix(rows["x"]), int(rows["cell"].iloc[0])
            a, b, length = _tree(x, p)
            near, step = np.full(len(pivots), np.inf), max(1, 1_000_000 // len(pivots))
            for c in range(0, len(x), step):
                near = np.minimum(near, distances(x[c:c + step], pivots, p).min(0))
            short = length <= limit
            yield _told(rows["rid"].to_numpy(), a[short], b[short], length[short])
            yield pd.DataFrame({"distance": [length.max(initial=0.0)], "cell": [cell], "low": [rows["off"].min()],
                                "high": [rows["off"].max()], "near": [near.tobytes()]})
    return lambda batches: (out.reindex(columns=["lo", "hi", "distance", "cell", "low", "high", "near"])
                            .astype({"lo": "Int64", "hi": "Int64", "cell": "Int32"}) for out in run(batches))


def _steps(near: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """Per pair of cells a length such that steps no longer lead from any row of the one to any of the other."""
    m = len(longest)
    w = np.maximum(np.minimum(near, near.T), np.maximum(longest[:, None], longest))
    out = np.zeros((m, m))
    a, b, length = np.zeros(m, int), np.arange(m), w[0].copy()
    edges, rest = [], np.arange(m) > 0
    while rest.any():  # the cells' own minimum spanning tree
        at = int(np.where(rest, length, np.inf).argmin()) if np.isfinite(length[rest]).any() else int(rest.argmax())
        edges.append((length[at], a[at], b[at]))
        rest[at] = False
        nearer = rest & (w[at] < length)
        a[nearer], length[nearer] = at, w[at][nearer]
    group = {i: [i] for i in range(m)}
    of = list(range(m))
    for step, i, j in sorted(edges):
        one, two = group[of[i]], group.pop(of[j])
        out[np.ix_(one, two)] = out[np.ix_(two, one)] = step
        for c in two:
            of[c] = of[i]
        one += two
    return out


def _across(pivots: np.ndarray, p: float, names: np.ndarray, low: np.ndarray, high: np.ndarray, reach: np.ndarray):
    """Other cells that may hold something within ``reach`` (by pair of cells), one list per row."""
    at = np.zeros(len(pivots), int)
    at[names] = np.arange(len(names))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d = distances(_matrix(pdf["x"]), pivots, p)[:, names]
            off, home = pdf["off"].to_numpy()[:, None], pdf["cell"].to_numpy()
            ring = np.maximum(np.maximum(d - high, low - d), (d - off) / 2) - 1e-9 * (d + high + off)
            yield _listed(pdf[["rid", "x", "cell"]], (ring <= reach[at[home]]) & (home[:, None] != names), names)
    return run


def _between(p: float, limit: float):
    """Edges between two cells of the tree over those of their rows that may be near enough."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _runs(batches, ["a", "b"]):
            cell = rows["cell"].to_numpy()
            if (cell == cell[0]).all():
                continue
            a, b, length = _tree(_matrix(rows["x"]), p)
            keep = (cell[a] != cell[b]) & (length <= limit)
            yield _told(rows["rid"].to_numpy(), a[keep], b[keep], length[keep])
    return run


def _merged(edges: DataFrame) -> DataFrame:
    """``(comp, root)`` of groups that each point along their shortest edge.

    Edges are totally ordered, so the only circles are two groups that point at
    each other; the smaller of them is the root, and pointers are doubled until
    all show a root."""
    to = edges.select(F.col("comp").alias("pcomp"), F.col("pcomp").alias("back"))
    at = written(edges.join(to, "pcomp", "left").select("comp", F.when(
        (F.col("back") == F.col("comp")) & (F.col("comp") < F.col("pcomp")), F.col("comp"))
        .otherwise(F.col("pcomp")).alias("root")))
    while True:
        over = at.select(F.col("comp").alias("root"), F.col("root").alias("next"))
        after = written(at.join(over, "root", "left").select(
            "comp", F.coalesce("next", "root").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        at = after.select("comp", "root")
        if after.where("moved").isEmpty():
            return at


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The forest of at most ``HELD`` edges between components, and the smallest component of each tree."""
    held = [pdf for pdf in batches if len(pdf)]
    if not held:
        return
    edges = pd.concat(held).sort_values(["distance", "lo", "hi"], ignore_index=True)
    names, ends = np.unique(edges[["a", "b"]].to_numpy(), return_inverse=True)
    a, b = ends.reshape(-1, 2).T
    comp, taken, order = np.arange(len(names)), np.zeros(len(edges), bool), np.arange(len(edges))
    while True:
        ca, cb = comp[a], comp[b]
        order = order[ca[order] != cb[order]]
        if not len(order):
            break
        best = np.full(len(names), -1)
        back = order[::-1]
        both = np.stack([back, back], axis=1).ravel()
        best[np.stack([ca[back], cb[back]], axis=1).ravel()] = both  # the last, that is the shortest, stays
        at = np.flatnonzero(best >= 0)
        taken[best[at]] = True
        to = np.arange(len(names))
        to[at] = np.where(ca[best[at]] == at, cb[best[at]], ca[best[at]])
        circle = at[(to[to[at]] == at) & (at < to[at])]
        to[circle] = circle
        while (to[to] != to).any():
            to = to[to]
        comp = to[comp]
    least = np.full(len(names), len(names))
    np.minimum.at(least, comp, np.arange(len(names)))
    yield edges.loc[taken, ["lo", "hi", "distance"]].assign(comp=-1, root=-1, edge=True)
    yield pd.DataFrame({"lo": -1, "hi": -1, "distance": 0.0, "comp": names, "root": names[least[comp]], "edge": False})


def _thinned(edges: DataFrame, trees: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The minimum spanning forest of ``edges`` (``lo, hi, distance``), and ``trees`` (``id, root``: each id its own) by it."""
    spark, forest = edges.sparkSession, edges.limit(0)
    edges = edges.select(F.col("lo").alias("a"), F.col("hi").alias("b"), "lo", "hi", "distance")
    while edges.count() > HELD:
        e = F.struct("distance", "lo", "hi", "pcomp").alias("e")
        ends = edges.withColumnsRenamed({"a": "comp", "b": "pcomp"}).select("comp", e).unionByName(
            edges.withColumnsRenamed({"b": "comp", "a": "pcomp"}).select("comp", e))
        best = written(ends.groupBy("comp").agg(F.min("e").alias("e")).select(
            "comp", "e.pcomp", "e.lo", "e.hi", "e.distance"))
        forest = forest.unionByName(best.select("lo", "hi", "distance").distinct())
        roots = _merged(best)
        ra, rb = roots.toDF("a", "ra"), roots.toDF("b", "rb")
        edges = written(edges.join(ra, "a").join(rb, "b").where("ra <> rb").groupBy(
            F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).agg(
            F.min(F.struct("distance", "lo", "hi")).alias("e")).select("a", "b", "e.lo", "e.hi", "e.distance"))
        trees = written(trees.join(roots.toDF("root", "next"), "root", "left").select(
            "id", F.coalesce("next", "root").alias("root")))
    last = written(edges.repartition(1).mapInPandas(_joined, f"{_EDGE}, comp long, root long, edge boolean"))
    over = last.where("not edge")
    trees = trees.join(over.select(F.col("comp").alias("root"), F.col("root").alias("next")), "root", "left")
    return written(forest.unionByName(last.where("edge").select("lo", "hi", "distance"))), \
        written(trees.select("id", F.coalesce("next", "root").alias("root")))


def single_forest(vectors: DataFrame, limit: float = float("inf"), p: float = 2.0, pivots: int | None = None
                  ) -> tuple[DataFrame, DataFrame]:
    """``(lo, hi, distance)``: the minimum spanning forest of distinct finite
    vectors (``id, x``) with edges up to ``limit``, ties to the smaller ``lo``,
    then ``hi``; and ``(id, root)``, its trees."""
    spark = vectors.sparkSession
    ship_package(spark)
    if pivots is None:
        pivots = min(CELLS, max(1, -(-vectors.count() // CELL)))
    heads = vectors.select("x").orderBy(F.xxhash64("x"), "x").limit(pivots).collect()
    trees = vectors.select("id", F.col("id").alias("root"))
    if not heads:
        return spark.createDataFrame([], _EDGE), trees
    centres = np.array([r["x"] for r in heads], float)
    # tasks are dealt by their work, which is the square of a cell, not by their bytes
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    places = written(vectors.select(F.col("id").alias("rid"), "x").mapInPandas(
        _placed(centres, p), "rid long, x array<double>, cell int, off double"))
    own = written(places.repartition(tasks, "cell").sortWithinPartitions("cell").mapInPandas(
        _inside(centres, p, limit), f"{_EDGE}, cell int, low double, high double, near binary"))
    edges = own.where(F.col("lo").isNotNull()).select("lo", "hi", "distance")
    about = sorted(own.where(F.col("cell").isNotNull()).select("cell", "distance", "low", "high", "near").collect())
    if len(about) > 1:  # one row per cell
        names = np.array([r["cell"] for r in about])
        low, high, longest = (np.array([r[c] for r in about]) for c in ("low", "high", "distance"))
        near = np.array([np.frombuffer(r["near"])[names] for r in about])
        reach = np.minimum(_steps(near, longest) * (1 + 1e-9), limit)
        met = places.mapInPandas(_across(centres, p, names, low, high, reach),
                                 "rid long, x array<double>, cell int, cells array<int>") \
            .select("rid", "x", "cell", F.explode("cells").alias("c")).select(
                F.least("cell", "c").alias("a"), F.greatest("cell", "c").alias("b"), "cell", "rid", "x")
        edges = written(edges.unionByName(met.repartition(tasks, "a", "b").sortWithinPartitions("a", "b")
                                          .mapInPandas(_between(p, limit), _EDGE)))
    return _thinned(edges, trees)


def cluster_single(df: DataFrame, array_col: str, id_col: str, k: int | None = 2, threshold: float | None = None,
                   p: float = 2.0, pivots: int | None = None) -> DataFrame:
    """``df`` with ``cluster`` (0, 1, .. by smallest row id) by exact single linkage.

    Either ``k`` clusters (the forest without its ``k - 1`` longest edges; of
    equal edges the largest ids go first; all distinct vectors, if fewer) or,
    with ``threshold``, rows linked by steps of at most that distance.  Equal
    vectors share a cluster.  ``id_col`` is unique; null clusters for rows
    without a finite vector, and rows with a null id take part only as far as
    their vector is that of a row with an id.
    """
    if threshold is None and (k is None or k < 1):
        raise ValueError("k of at least 1, or a threshold")
    rows = df.select(F.col(id_col).alias("_id"), F.col(array_col).cast("array<double>").alias("x")) \
        .where(_finite("x") & F.col("_id").isNotNull()).groupBy("x").agg(F.min("_id").alias("_id"))
    if isinstance(df.schema[id_col].dataType, T.IntegralType):
        vectors = written(rows.select(F.col("_id").cast("long").alias("id"), "x"))
    else:
        rows = written(rows)
        vectors = written(rows.join(dense_index(rows, "_id", "id"), "_id").select(F.col("id").cast("long"), "x"))
    forest, trees = single_forest(vectors, float("inf") if threshold is None else threshold, p, pivots)
    if threshold is None:
        cut = forest.orderBy(F.desc("distance"), F.desc("lo"), F.desc("hi")).limit(k - 1)
        forest = forest.join(cut.select("lo", "hi"), ["lo", "hi"], "left_anti")
        near = components(forest, "lo", "hi").select(F.col("node").alias("id"), F.col("component").alias("root"))
        trees = vectors.select("id").join(near, "id", "left").withColumn("root", F.coalesce("root", "id"))
    first = trees.groupBy("root").agg(F.min("id").alias("first"))
    named = written(vectors.join(trees, "id").join(first, "root").select("x", F.col("first").alias("root")))
    told = named.join(dense_index(named.select("root").distinct(), "root", "cluster"), "root") \
        .select(F.col("x").alias("_nx"), F.col("cluster").cast("long").alias("cluster"))
    return df.withColumn("_qx", F.col(array_col).cast("array<double>")) \
        .join(told, F.col("_qx") == F.col("_nx"), "left").drop("_qx", "_nx")
