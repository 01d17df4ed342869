"""Exact nearest-neighbour joins by pivots, for references of any size.

References fall into cells around a bounded number of pivots drawn by a hash;
a cell knows its size and radius.  A query first searches the cell of its
nearest pivot, which bounds its k-th distance; by the triangle inequality only
cells whose ring can hold something nearer are searched in a second round.
Equal references count as one vector with its ``k`` smallest ids, and equal
queries are asked once.  Cells are dealt in blocks of references and salts of
queries, so a task holds one block and streams the queries past it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomkit.functions.prefix import dense_index
from loomkit.session import cut_lineage, ship_package

PIVOTS, BLOCK = 128, 4096
CELLS, PIECE = 2_000_000, 64  # distances a task holds at once; references of which one minimum bounds the search


def _finite(c: str):
    return F.col(c).isNotNull() & (F.size(c) > 0) & F.forall(
        c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def _matrix(col: pd.Series) -> np.ndarray:
    return np.array(col.tolist(), float).reshape(len(col), -1)


def distances(x: np.ndarray, y: np.ndarray, p: float) -> np.ndarray:
    """Minkowski distances of the rows of ``x`` and ``y``, in bounded pieces."""
    out = np.empty((len(x), len(y)))
    step = max(1, 2_000_000 // max(1, y.size))
    for a in range(0, len(x), step):
        diff = x[a:a + step, None, :] - y[None, :, :]
        out[a:a + step] = np.sqrt((diff * diff).sum(-1)) if p == 2 else (np.abs(diff) ** p).sum(-1) ** (1 / p)
    return out


def _placed(pivots: np.ndarray, p: float):
    """Nearest pivot of every row, and the distance to it."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d = distances(_matrix(pdf["x"]), pivots, p)
            cell = d.argmin(1)
            yield pdf.assign(cell=cell.astype(np.int32), off=d[np.arange(len(d)), cell])
    return run


def _second(pivots: np.ndarray, p: float, radius: dict):
    """Cells, the home cell apart, that may hold something within ``bound``, one list per row."""
    cells = np.array(sorted(radius))
    low, high = (np.array([radius[c][i] for c in cells]) for i in (0, 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d = distances(_matrix(pdf["x"]), pivots, p)[:, cells]
            # differences of distances err by their size, not by the size of the gap
            ring = np.maximum(d - high, low - d) - 1e-9 * (d + high)
            home = pdf["cell"].to_numpy()[:, None] == cells
            yield _listed(pdf[["qid", "x", "own", "bound"]], (ring <= pdf["bound"].to_numpy()[:, None]) & ~home, cells)
    return run


def _listed(rows: pd.DataFrame, found: np.ndarray, cells: np.ndarray) -> pd.DataFrame:
    """``rows`` with the ``cells`` that each was ``found`` in, where there are any; vectors are not repeated here."""
    some = found.any(1)
    lists = pd.Series([cells[f].astype(np.int32) for f in found[some]], dtype=object)  # lists, even where none is left
    return rows[some].reset_index(drop=True).assign(cells=lists)


def _search(k: int, p: float, apart: bool):
    """Blocks come one after the other, references first; ``k`` best per query and block."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rows, block = None, [], None
        for pdf in batches:
            ids = pdf[["cell", "block", "salt", "kind"]].to_numpy()
            cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1), len(ids)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                part = pdf.iloc[a:b]
                if key != tuple(ids[a, :3]):
                    key, rows, block = tuple(ids[a, :3]), [], None
                if not ids[a, 3]:
                    rows.append(part)
                elif rows:
                    if block is None:
                        whole = pd.concat(rows).sort_values("id")
                        block = _matrix(whole["x"]), whole["id"].to_numpy(), whole["own"].to_numpy()
                    yield _best(part, *block, k, p, apart)
    return run


def _kth(d: np.ndarray, k: int) -> np.ndarray:
    """Per row a number that at least ``k`` entries do not exceed (infinite where there are none)."""
    m, n = d.shape
    if n <= k:
        return np.full(m, np.inf)
    if k == 1:
        return d.min(1)
    wide = n // PIECE
    if wide >= k:  # a minimum each of as many pieces: the k-th of them is no less than the k-th of all
        d = np.minimum.reduce(d[:, :wide * PIECE].reshape(m, wide, PIECE), axis=2)
    return np.partition(d, k - 1, axis=1)[:, k - 1]


def _squared(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by one product of matrices, and per row what they may err by."""
    qq, xx = (q * q).sum(1), (x * x).sum(1)
    d = q @ x.T
    d *= -2.0
    d += qq[:, None]
    d += xx
    return d, 1e-15 * (q.shape[1] + 8) * (np.sqrt(qq) + np.sqrt(xx.max())) ** 2


def _pairwise(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Euclidean distances of the named pairs, in bounded pieces."""
    out, step = np.empty(len(i)), max(1, CELLS // max(1, q.shape[1]))
    for a in range(0, len(i), step):
        diff = q[i[a:a + step]] - x[j[a:a + step]]
        out[a:a + step] = np.sqrt((diff * diff).sum(-1))
    return out


def _best(part: pd.DataFrame, x: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, p: float,
          apart: bool) -> pd.DataFrame:
    """``k`` best within ``bound`` per query.  Euclidean distances come from a
    product of matrices first; those it cannot rule out are measured exactly."""
    q, name, home, bound = (_matrix(part["x"]), *(part[c].to_numpy() for c in ("id", "own", "bound")))
    step, out = max(1, CELLS // max(1, len(ids))), []
    for a in range(0, len(q), step):
        some, limit = q[a:a + step], bound[a:a + step]
        with np.errstate(over="ignore", invalid="ignore"):
            d, err = _squared(some, x) if p == 2 else (distances(some, x, p), 0.0)
            rough = p == 2 and bool(np.isfinite(d).all())
            if p == 2 and not rough:  # squares beyond the largest number
                d, err = distances(some, x, p), 0.0
        if apart:
            d[home[a:a + step, None] == own] = np.inf
        top = limit * limit * (1 + 1e-9) if rough else limit
        i, j = np.nonzero((d <= (np.minimum(_kth(d, k), top) + 2 * err)[:, None]) & (d < np.inf))
        far = _pairwise(some, x, i, j) if rough else d[i, j]
        order = np.lexsort((j, far, i))  # by id where equal
        i, j, far = i[order], j[order], far[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        keep = (rank < k) & (far <= limit[i]) & np.isfinite(far)
        out.append(pd.DataFrame({"qid": name[a:a + step][i[keep]], "rid": ids[j[keep]], "distance": far[keep]}))
    return pd.concat(out)


def _round(asked: DataFrame, refs: DataFrame, cells: dict, k: int, p: float, apart: bool) -> DataFrame:
    """``asked`` (``qid, x, own``, a ``cell`` or a list ``cells``) against the
    references of their cells, within ``bound`` where they have one."""
    if "bound" not in asked.columns:
        asked = asked.withColumn("bound", F.lit(float("inf")))
    if "cells" in asked.columns:
        asked = asked.select("qid", "x", "own", "bound", F.explode("cells").alias("cell"))
    sizes = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks, salts = ({c: max(1, -(-n // BLOCK)) for c, n in t.items()}
                     for t in ({c: v[2] for c, v in cells.items()}, sizes))

    def of(table: dict):  # at most PIVOTS entries
        return F.coalesce(F.create_map(*[F.lit(int(v)) for kv in table.items() for v in kv])[F.col("cell")], F.lit(1)) \
            if table else F.lit(1)
    first = refs.where(F.col("cell").isin([int(c) for c in sizes])).select(
        "cell", F.pmod(F.xxhash64("rid"), of(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), of(salts) - 1)).alias("salt"), F.lit(0).alias("kind"),
        F.col("rid").alias("id"), "x", "own", F.lit(0.0).alias("bound"))
    then = asked.select(
        "cell", F.explode(F.sequence(F.lit(0), of(blocks) - 1)).alias("block"),
        F.pmod(F.xxhash64("qid"), of(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"),
        F.col("qid").alias("id"), "x", "own", "bound")
    return first.unionByName(then).repartition("cell", "block", "salt") \
        .sortWithinPartitions("cell", "block", "salt", "kind") \
        .mapInPandas(_search(k, p, apart), "qid long, rid long, distance double")


def _top(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("qid").orderBy("distance", "rid")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def numbered(df: DataFrame, array_col: str) -> DataFrame:
    """``(qid, x)``: the distinct finite vectors of a column."""
    x = df.select(F.col(array_col).cast("array<double>").alias("x")).where(_finite("x")).distinct()
    return cut_lineage(x.select(F.monotonically_increasing_id().alias("qid"), "x"))


def nearest_vectors(queries: DataFrame, refs: DataFrame, k: int, p: float = 2.0, pivots: int = PIVOTS,
                    apart: bool = False) -> DataFrame:
    """``(qid, rid, distance, rank)``: the ``k`` nearest of ``refs`` (``rid, x``) for
    every query (``qid, x``), ties to the smaller ``rid``.

    Exact for any Minkowski order ``p`` of at least 1.  With ``apart`` both
    sides carry ``own``, and only references of another group are candidates.
    """
    if p < 1:
        raise ValueError("the triangle inequality needs an order of at least 1")
    ship_package(queries.sparkSession)
    if not apart:
        queries, refs = (t.withColumn("own", F.lit(0).cast("long")) for t in (queries, refs))
    heads = refs.select("x").orderBy(F.xxhash64("x"), "x").limit(pivots).collect()
    if not heads:
        return queries.select("qid", F.lit(0).cast("long").alias("rid"), F.lit(0.0).alias("distance"),
                              F.lit(1).alias("rank")).limit(0)
    centres = np.array([r["x"] for r in heads], float)
    place = lambda t, key: t.select(key, "x", "own").mapInPandas(
        _placed(centres, p), f"{key} long, x array<double>, own long, cell int, off double")
    refs = cut_lineage(place(refs, "rid"))
    cells = {r["cell"]: (r["lo"], r["hi"], r["n"]) for r in refs.groupBy("cell").agg(
        F.min("off").alias("lo"), F.max("off").alias("hi"), F.count(F.lit(1)).alias("n")).collect()}
    asked = cut_lineage(place(queries, "qid"))
    near = cut_lineage(_top(_round(asked, refs, cells, k, p, apart), k))
    bound = near.groupBy("qid").agg(F.count(F.lit(1)).alias("c"), F.max("distance").alias("bound"))
    open_ = asked.join(bound, "qid", "left").select(
        "qid", "x", "own", "cell", F.when(F.col("c") >= k, F.col("bound")).otherwise(float("inf")).alias("bound"))
    more = cut_lineage(open_.mapInPandas(
        _second(centres, p, cells), "qid long, x array<double>, own long, bound double, cells array<int>"))
    return _top(near.drop("rank").unionByName(_round(more, refs, cells, k, p, apart)), k)


def nearest_rows(df: DataFrame, array_col: str, reference: DataFrame, ref_array: str, ref_id: str, k: int,
                 p: float = 2.0, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """Distinct query vectors ``(qid, x)`` and their ``k`` nearest reference rows
    ``(qid, ref_id, distance, rank)``, ties to the smaller id.

    Rows without a finite vector take no part on either side; of equal
    reference vectors only the ``k`` smallest ids can be among the nearest.
    """
    asked = numbered(df, array_col)
    rows = reference.select(F.col(ref_id).alias("_id"), F.col(ref_array).cast("array<double>").alias("x")) \
        .where(_finite("x") & F.col("_id").isNotNull())
    same = Window.partitionBy("x").orderBy("_id")
    few = cut_lineage(rows.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k))
    # equal vectors meet at their smallest id, so ties keep the order of the ids
    vectors = few.where("_n = 1")
    if isinstance(reference.schema[ref_id].dataType, T.IntegralType):
        vectors = vectors.select("x", F.col("_id").cast("long").alias("rid"))
    else:
        vectors = vectors.join(dense_index(vectors, "_id", "rid"), "_id").select("x", "rid")
    vectors = cut_lineage(vectors)
    near = nearest_vectors(asked, vectors, k, p, pivots).join(vectors, "rid").drop("rid") \
        .join(few.select("x", F.col("_id").alias("rid")), "x").select("qid", "rid", "distance")
    return asked, _top(near, k).withColumnRenamed("rid", ref_id)


def assign_nearest(df: DataFrame, array_col: str, reference: DataFrame, ref_array: str, ref_label: str,
                   ref_id: str) -> DataFrame:
    """``df`` with ``nearest_id``, its label as ``cluster`` and the euclidean
    ``distance`` of each row's nearest reference row (ties: the smaller id).

    ``ref_id`` is unique.  Null for rows without a finite vector, and for all
    rows where no reference has one."""
    asked, near = nearest_rows(df, array_col, reference, ref_array, ref_id, 1)
    labels = reference.select(F.col(ref_id).alias("nearest_id"), F.col(ref_label).alias("cluster"))
    told = asked.join(near.select("qid", F.col(ref_id).alias("nearest_id"), "distance"), "qid") \
        .join(labels, "nearest_id").select(F.col("x").alias("_nx"), "nearest_id", "cluster", "distance")
    return df.withColumn("_qx", F.col(array_col).cast("array<double>")) \
        .join(told, F.col("_qx") == F.col("_nx"), "left").drop("_qx", "_nx")


def knn_predict(df: DataFrame, array_col: str, reference: DataFrame, ref_array: str, ref_label: str, ref_id: str,
                k: int = 5, weights: str = "uniform", p: float = 2.0, regression: bool = False) -> DataFrame:
    """``df`` with ``prediction``: vote (ties: the smallest label) or mean of the
    ``k`` nearest reference rows, ties in distance to the smaller id.

    ``weights``: ``uniform`` or ``distance`` (1 / d; where some neighbour has
    distance 0, only such count).  Null for rows without a finite vector."""
    if weights not in ("uniform", "distance"):
        raise ValueError(f"weights={weights!r}")
    asked, near = nearest_rows(df, array_col, reference, ref_array, ref_id, k, p)
    told = near.join(reference.select(ref_id, F.col(ref_label).alias("_label")), ref_id)
    zero = F.min("distance").over(Window.partitionBy("qid")) == 0
    weight = F.lit(1.0) if weights == "uniform" else \
        F.when(zero, (F.col("distance") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.col("distance")))
    told = told.withColumn("_w", weight)
    if regression:
        said = told.groupBy("qid").agg((F.sum(F.col("_w") * F.col("_label")) / F.sum("_w")).alias("prediction"))
    else:
        votes = told.groupBy("qid", "_label").agg(F.sum("_w").alias("_v"))
        said = votes.groupBy("qid").agg(F.min(F.struct((-F.col("_v")).alias("v"), F.col("_label").alias("l")))["l"]
                                        .alias("prediction"))
    told = asked.join(said, "qid").select(F.col("x").alias("_nx"), "prediction")
    return df.withColumn("_qx", F.col(array_col).cast("array<double>")) \
        .join(told, F.col("_qx") == F.col("_nx"), "left").drop("_qx", "_nx")


class KnnModel:
    """k-nearest-neighbour model over a ``features`` / ``label`` frame of any size."""

    def __init__(self, train: DataFrame, hp: dict, regression: bool):
        self.rows = cut_lineage(train.select(F.monotonically_increasing_id().alias("id"),
                                             vector_to_array("features").alias("x"), "label"))
        self.how = {"k": int(hp.get("n_neighbors", 5)), "weights": hp.get("weights", "uniform"),
                    "p": float(hp.get("p", 2)), "regression": regression}

    def transform(self, df: DataFrame) -> DataFrame:
        asked = df.withColumn("_features", vector_to_array("features"))
        return knn_predict(asked, "_features", self.rows, "x", "label", "id", **self.how).drop("_features")
