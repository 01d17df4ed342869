"""DBSCAN by cells: no pair of rows inside a cell is ever formed.

Rows fall into grid cells of side ``eps / sqrt(d)``, so all rows of a cell are
within ``eps`` of each other: a cell with ``min_samples`` rows is all core, and
the core rows of any cell are one cluster.  Only rows of thinner cells (fewer
than ``min_samples`` each) count their neighbours, cell by cell: a neighbour
cell whose box lies wholly within ``eps`` counts by its size, others are dealt
over salts by size.  Two core cells are joined if a pair of their core rows is
within ``eps``; this is decided on boxes that are refined only where they
neither prove nor exclude a pair, so two hot cells cost their frontier, not
their product.  Clusters are the connected components of the cell graph.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomkit.functions.graph import components
from loomkit.functions.prefix import dense_index
from loomkit.session import cut_lineage

SALT_ROWS = 20_000  # rows of a cell that one task compares


class _Metric:
    """Distances between boxes as sums over coordinates: squares for the
    euclidean distance, absolute values for the manhattan distance."""

    def __init__(self, eps: float, d: int, manhattan: bool):
        self.term = (lambda v: F.abs(v)) if manhattan else (lambda v: v * v)
        self.limit = eps if manhattan else eps * eps
        # a hair below, so that no rounding makes a cell too wide
        self.eps, self.side, self.d = eps, (eps / d if manhattan else eps / math.sqrt(d)) * (1 - 1e-9), d

    def _sum(self, parts: Column) -> Column:
        return F.aggregate(parts, F.lit(0.0), lambda s, v: s + self.term(v))

    def gap(self, lo_a: str, hi_a: str, lo_b: str, hi_b: str) -> Column:
        """Between two boxes (points are boxes with equal ends)."""
        return self._sum(F.zip_with(F.zip_with(lo_a, hi_b, lambda x, y: x - y),
                                    F.zip_with(lo_b, hi_a, lambda x, y: x - y),
                                    lambda p, q: F.greatest(p, q, F.lit(0.0))))

    def reach(self, lo_a: str, hi_a: str, lo_b: str, hi_b: str) -> Column:
        """Between the farthest points of two boxes."""
        return self._sum(F.zip_with(F.zip_with(hi_a, lo_b, lambda x, y: x - y),
                                    F.zip_with(hi_b, lo_a, lambda x, y: x - y), lambda p, q: F.greatest(p, q)))

    def distance(self, x: str, y: str) -> Column:
        return self._sum(F.zip_with(x, y, lambda p, q: p - q))


def _boxes(points: DataFrame, keys: list[str], d: int) -> DataFrame:
    ends = [f(F.col("x")[i]).alias(f"{n}{i}") for n, f in (("_lo", F.min), ("_hi", F.max)) for i in range(d)]
    return points.groupBy(*keys).agg(*ends, F.count(F.lit(1)).alias("n"), F.min("x").alias("one")).select(
        *keys, F.array(*[F.col(f"_lo{i}") for i in range(d)]).alias("lo"),
        F.array(*[F.col(f"_hi{i}") for i in range(d)]).alias("hi"), "n", "one")


def _neighbour_cells(cells: DataFrame, metric: _Metric) -> DataFrame:
    """Pairs of cells (each with itself too) whose boxes are within ``eps``; they
    meet by equi-joins on shifted zones of side ``eps`` in three dimensions at most."""
    m = min(metric.d, 3)
    zoned = cells.withColumn("zone", F.array(*[F.floor(F.col("cell")[i] * F.lit(metric.side / metric.eps)) for i in range(m)]))
    steps = [[]]
    for _ in range(m):
        steps = [[*s, k] for s in steps for k in (-2, -1, 0, 1, 2)]
    shifts = F.array(*[F.array(*[F.lit(k).cast("long") for k in s]) for s in steps])
    left = zoned.select(F.col("cell").alias("cell_a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"), "zone",
                        F.explode(shifts).alias("step")) \
        .withColumn("zone", F.zip_with("zone", "step", lambda z, s: z + s)).drop("step")
    right = zoned.select(F.col("cell").alias("cell_b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"),
                         F.col("n").alias("n_b"), "zone")
    return left.join(right, "zone").where(metric.gap("lo_a", "hi_a", "lo_b", "hi_b") <= metric.limit).drop("zone")


def _meet(asked: DataFrame, points: DataFrame) -> DataFrame:
    """Rows of ``asked`` (``cell_b, n_b`` and own columns) beside the rows of cell
    ``cell_b``; a large cell is dealt over salts."""
    salts = lambda n: F.ceil(n / SALT_ROWS).cast("int")
    dealt = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), salts(F.col("n_b")) - 1)))
    known = points.select(F.col("cell").alias("cell_b"), F.col("x").alias("y"),
                          *[c for c in ("component",) if c in points.columns],
                          F.pmod(F.xxhash64("id"), salts(F.col("n"))).cast("int").alias("salt"))
    return dealt.join(known, ["cell_b", "salt"])


def _linked_cells(core: DataFrame, pairs: DataFrame, metric: _Metric) -> DataFrame:
    """Pairs of cells with core rows within ``eps`` of each other."""
    open_pairs = pairs.select("cell_a", "cell_b", F.col("cell_a").alias("sub_a"), F.col("cell_b").alias("sub_b"))
    links, width = None, metric.side
    sub = core.withColumn("sub", F.col("cell"))
    while True:
        boxes = cut_lineage(_boxes(sub, ["cell", "sub"], metric.d))
        named = lambda t: boxes.select(*[F.col(c).alias(f"{c}_{t}") for c in ("cell", "sub", "lo", "hi", "one")])
        met = open_pairs.join(named("a"), ["cell_a", "sub_a"]).join(named("b"), ["cell_b", "sub_b"]) \
            .where(metric.gap("lo_a", "hi_a", "lo_b", "hi_b") <= metric.limit)
        sure = (metric.reach("lo_a", "hi_a", "lo_b", "hi_b") <= metric.limit) \
            | (metric.distance("one_a", "one_b") <= metric.limit)
        met = cut_lineage(met.select("cell_a", "cell_b", "sub_a", "sub_b", sure.alias("sure")))
        found = met.where("sure").select("cell_a", "cell_b").distinct()
        links = found if links is None else links.unionByName(found)
        rest = met.join(found, ["cell_a", "cell_b"], "left_anti")
        if rest.limit(1).count() == 0:
            return links
        # a finer grid for what is open: quarter the boxes, and pair the parts of open pairs
        width /= 4
        finer = F.transform("x", lambda v: F.floor(v / F.lit(width)))
        kept = sub.join(rest.select(F.col("cell_a").alias("cell"), F.col("sub_a").alias("sub"))
                        .unionByName(rest.select(F.col("cell_b").alias("cell"), F.col("sub_b").alias("sub")))
                        .distinct(), ["cell", "sub"], "left_semi")
        split = cut_lineage(kept.withColumn("up", F.col("sub")).withColumn("sub", finer))
        parts = split.select("cell", "up", "sub").distinct()
        open_pairs = rest.select("cell_a", "cell_b", F.col("sub_a").alias("up_a"), F.col("sub_b").alias("up_b")) \
            .join(parts.select(F.col("cell").alias("cell_a"), F.col("up").alias("up_a"), F.col("sub").alias("sub_a")),
                  ["cell_a", "up_a"]) \
            .join(parts.select(F.col("cell").alias("cell_b"), F.col("up").alias("up_b"), F.col("sub").alias("sub_b")),
                  ["cell_b", "up_b"]).select("cell_a", "cell_b", "sub_a", "sub_b")
        sub = split.drop("up")


def cluster_dbscan(df: DataFrame, array_col: str, id_col: str, eps: float = 0.5, min_samples: int = 5,
                   metric: str = "euclidean") -> DataFrame:
    """``(id_col, cluster, core)`` of every row: DBSCAN under the ``euclidean``,
    ``manhattan`` or ``cosine`` distance (unit vectors; a zero vector is noise).

    A core row has ``min_samples`` rows within ``eps``, itself included.
    Clusters are numbered from 0 by their smallest core id; a border row joins
    the cluster of its nearest core row (ties: the smaller cluster); all others
    are noise, -1.  Rows without a finite vector are noise.  ``id_col`` must be
    unique.  Any dimension is exact; beyond three the zones of the first three
    coordinates alone keep cells apart.
    """
    if eps <= 0 or min_samples < 1:
        raise ValueError("eps must be positive and min_samples at least 1")
    if metric not in ("euclidean", "manhattan", "cosine"):
        raise ValueError(f"metric={metric!r}")
    rows = df.select(F.col(id_col).alias("id"), F.col(array_col).cast("array<double>").alias("x"))
    if metric == "cosine":  # 1 - cos = half the squared distance of unit vectors
        norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
        rows = rows.select("id", F.transform("x", lambda v: F.try_divide(v, norm)).alias("x"))
        eps = math.sqrt(2 * eps)
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    dims = rows.where(finite).agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    empty = df.select(id_col, F.lit(-1).cast("long").alias("cluster"), F.lit(False).alias("core"))
    if dims[0] is None or dims[1] == 0:
        return empty
    if dims[0] != dims[1]:
        raise ValueError("vectors differ in length")
    d = dims[0]
    metric = _Metric(eps, d, metric == "manhattan")
    points = rows.where(finite).withColumn("cell", F.transform("x", lambda v: F.floor(v / F.lit(metric.side))))
    cells = cut_lineage(_boxes(points, ["cell"], d))
    pairs = cut_lineage(_neighbour_cells(cells, metric))
    points = cut_lineage(points.join(cells.select("cell", "n"), "cell"))

    # rows of thin cells: whole neighbour cells by size, the others row by row
    thin = points.where(F.col("n") < min_samples).select("id", "x", F.col("cell").alias("cell_a"))
    asked = thin.join(pairs.select("cell_a", "cell_b", "lo_b", "hi_b", "n_b"), "cell_a") \
        .where(metric.gap("x", "x", "lo_b", "hi_b") <= metric.limit)
    whole = metric.reach("x", "x", "lo_b", "hi_b") <= metric.limit
    counted = asked.where(whole).select("id", F.col("n_b").alias("c")).unionByName(
        _meet(asked.where(~whole).select("id", "x", "cell_b", "n_b"), points)
        .where(metric.distance("x", "y") <= metric.limit).select("id", F.lit(1).cast("long").alias("c")))
    enough = counted.groupBy("id").agg(F.sum("c").alias("c")).where(F.col("c") >= min_samples).select("id")
    core = cut_lineage(points.where(F.col("n") >= min_samples).select("id", "x", "cell").unionByName(
        points.where(F.col("n") < min_samples).join(enough, "id", "left_semi").select("id", "x", "cell")))

    core_cells = core.groupBy("cell").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n"))
    key = lambda t: core_cells.select(F.col("cell").alias(f"cell_{t}"), F.col("node").alias(t))
    # one direction is enough; a cell's smallest core id stands for it
    near = cut_lineage(pairs.select("cell_a", "cell_b").join(key("a"), "cell_a").join(key("b"), "cell_b")
                       .where(F.col("a") < F.col("b")))
    linked = _linked_cells(core, near.select("cell_a", "cell_b"), metric)
    groups = components(near.join(linked, ["cell_a", "cell_b"], "left_semi"))
    named = core_cells.join(groups, "node", "left").select(
        "cell", "n", F.coalesce("component", "node").alias("component"))
    numbers = dense_index(named, "component", "cluster")
    named = cut_lineage(named.join(numbers, "component").select("cell", "n", F.col("cluster").alias("component")))

    of_core = core.join(named, "cell")
    border = points.join(core.select("id"), "id", "left_anti").select("id", "x", F.col("cell").alias("cell_a"))
    reach = border.join(pairs.select("cell_a", "cell_b", "lo_b", "hi_b"), "cell_a") \
        .where(metric.gap("x", "x", "lo_b", "hi_b") <= metric.limit) \
        .join(named.select(F.col("cell").alias("cell_b"), F.col("n").alias("n_b")), "cell_b")
    nearest = _meet(reach.select("id", "x", "cell_b", "n_b"), of_core) \
        .withColumn("d2", metric.distance("x", "y")).where(F.col("d2") <= metric.limit) \
        .groupBy("id").agg(F.min(F.struct("d2", "component")).alias("best"))
    told = of_core.select("id", F.col("component").alias("cluster"), F.lit(True).alias("core")).unionByName(
        nearest.select("id", F.col("best.component").alias("cluster"), F.lit(False).alias("core")))
    return df.select(F.col(id_col).alias("id")).join(told, "id", "left").select(
        F.col("id").alias(id_col), F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"),
        F.coalesce("core", F.lit(False)).alias("core"))
