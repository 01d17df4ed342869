"""Tree ensembles grown from grouped sums.

Trees live on the driver as flat arrays (bounded by the model's size); rows
stay in a checkpointed frame.  A level is one aggregation for all trees at
once: rows walk to their open node and are combined inside the map stage
(batches, with numpy) before the shuffle, so what is shuffled is (open nodes x features x bins) whatever the number of rows and
however unequal the nodes are.  The best split of each open node is chosen by
Spark; the driver reads one row per node.

* ``fit_boosting``: second-order boosting (gradient and hessian histograms,
  L1 and L2 in the leaf value, row and column sampling, missing values sent to
  the better side, growth by level or best leaf first).
* ``fit_extra_trees``: one random threshold per (tree, node, feature) between
  the smallest and the largest value of the node.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import math

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomkit.session import cut_lineage, ship_package, written

HELD = 2_000_000  # places of a level's histogram that a task holds; a larger one leaves it batch by batch
CHECKPOINT_ROUNDS = 8  # rounds of boosting between two checkpoints of the margins


# Test of one value (the hot expressions are SQL text, one call each).
VALUE_MISSING = "({v} IS NULL OR isnan({v}))"


def _table(values: list, kind: str) -> str:
    """A constant array (folded once by the optimizer)."""
    return f"from_json('{json.dumps(values)}', 'array<{kind}>')"


class Forest:
    """Trees as flat arrays: ``feature`` (-1 at a leaf), ``threshold``
    (``value <= threshold`` goes left), ``left`` (the right child follows it),
    ``miss_left`` and one ``value`` list per node; ``roots`` are node ids."""

    def __init__(self):
        self.feature, self.threshold, self.left, self.miss_left = [], [], [], []
        self.value, self.depth, self.roots = [], [], []

    def node(self, value: list[float], depth: int) -> int:
        self.feature.append(-1)
        self.threshold.append(0.0)
        self.left.append(0)
        self.miss_left.append(False)
        self.value.append([float(v) for v in value])
        self.depth.append(depth)
        return len(self.feature) - 1

    def split(self, at: int, feature: int, threshold: float, miss_left: bool,
              left: list[float], right: list[float]) -> int:
        """Split node ``at``; the left child's id is returned."""
        child = self.node(left, self.depth[at] + 1)
        self.node(right, self.depth[at] + 1)
        self.feature[at], self.threshold[at] = int(feature), float(threshold)
        self.left[at], self.miss_left[at] = child, bool(miss_left)
        return child

    def leaves(self, x: str, missing: str) -> str:
        """SQL of an array: the leaf reached in every tree by the values in the
        array column ``x``."""
        feature, v = f"get({_table(self.feature, 'int')}, n_)", f"get({x}, get({_table(self.feature, 'int')}, n_))"
        step = (f"CASE WHEN {feature} < 0 THEN n_ ELSE get({_table(self.left, 'int')}, n_) + CASE WHEN "
                f"CASE WHEN {missing.format(v=v)} THEN get({_table(self.miss_left, 'boolean')}, n_) "
                f"ELSE {v} <= get({_table(self.threshold, 'double')}, n_) END THEN 0 ELSE 1 END END")
        return (f"transform({_table(self.roots, 'int')}, r_ -> "
                f"aggregate(array_repeat(0, {max([0, *self.depth])}), r_, (n_, s_) -> {step}))")

    def totals(self, x: str, missing: str, k: int) -> str:
        """SQL of an array of length ``k``: the leaf values summed over trees."""
        return (f"aggregate({self.leaves(x, missing)}, {_table([0.0] * k, 'double')}, (acc_, leaf_) -> "
                f"zip_with(acc_, get({_table(self.value, 'array<double>')}, leaf_), (a_, b_) -> a_ + b_))")


class ForestModel(Model):
    """Scores rows with a ``Forest``: ``margin -> prediction`` (and
    ``probability`` for classes), column expressions only."""

    def __init__(self, forest: Forest, kind: str, k: int, base: list[float], scale: float = 1.0):
        super().__init__()
        self.forest, self.kind, self.k, self.base, self.scale = forest, kind, k, base, scale

    def _transform(self, df: DataFrame) -> DataFrame:
        total = self.forest.totals("_x", VALUE_MISSING, len(self.base))
        out = df.withColumn("_x", vector_to_array("features")).withColumn("_m", F.expr(
            f"zip_with({total}, {_table(self.base, 'double')}, (t_, b_) -> t_ * {self.scale!r}D + b_)")).drop("_x")
        if self.kind == "regression":
            return out.withColumn("prediction", F.col("_m")[0]).drop("_m")
        if self.kind == "share":  # averaged class shares
            p = F.col("_m")
        elif self.kind == "binary":
            one = 1.0 / (1.0 + F.exp(-F.col("_m")[0]))
            p = F.array(1.0 - one, one)
        else:
            p = F.expr(_softmax("_m"))
        out = out.withColumn("_p", p).drop("_m")
        best = F.array_position("_p", F.array_max("_p")) - 1  # ties: the smallest class
        return out.withColumn("probability", array_to_vector("_p")) \
                  .withColumn("prediction", best.cast("double")).drop("_p")


def _softmax(m: str) -> str:
    e = f"transform({m}, v_ -> exp(v_ - array_max({m})))"
    return f"transform({e}, e_ -> e_ / aggregate({e}, 0D, (a_, b_) -> a_ + b_))"


# ---------------------------------------------------------------- boosting

def bin_edges(df: DataFrame, x: str, d: int, max_bins: int = 255) -> list[list[float]]:
    """Per feature the distinct approximate quantiles, at most ``max_bins`` - 1
    of them; a feature whose values each hold 1 / ``max_bins`` of the rows or
    more is cut at every value."""
    probs = ", ".join(f"{i / max_bins!r}D" for i in range(1, max_bins))
    each = [f"get({x}, {j})" for j in range(d)]
    row = df.agg(*[F.expr(f"percentile_approx(CASE WHEN NOT {VALUE_MISSING.format(v=v)} THEN {v} END, "
                          f"array({probs}), {20 * max_bins}) AS q{j}") for j, v in enumerate(each)]).first()
    return [sorted(set(row[f"q{j}"] or [])) for j in range(d)]


def _binned(df: DataFrame, edges: list[list[float]], base: list[float]) -> DataFrame:
    """``id, y, bins, m``: bins (0 for a missing value, else 1 + (edges below it)) and first margins as bytes."""
    cuts = [np.asarray(e, dtype=float) for e in edges]
    first = np.array(base, float).tobytes()

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            v = np.vstack(pdf["x"].to_numpy()).astype(float)
            out = np.empty(v.shape, dtype=np.int32)
            for j, c in enumerate(cuts):
                out[:, j] = np.where(np.isnan(v[:, j]), 0, 1 + np.searchsorted(c, v[:, j], side="left"))
            yield pdf[["id", "y"]].assign(bins=_as_bytes(out), m=first)

    return df.select("id", "y", "x").mapInPandas(run, _FRAME)


_FRAME = "id long, y double, bins binary, m binary"


def _as_bytes(rows: np.ndarray) -> list:
    data, width = rows.tobytes(), rows.itemsize * rows.shape[1]
    return [data[i:i + width] for i in range(0, len(data), width)]


def _rows_of(column: pd.Series, kind: type) -> np.ndarray:
    """A matrix from rows as bytes or as lists."""
    if isinstance(column.iloc[0], (bytes, bytearray)):
        return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)
    return np.vstack(column.to_numpy()).astype(kind)


def _dealt(forest: Forest, root: int, bins: np.ndarray):
    """The leaves of a tree, each with the rows that reach it (``bins``: a row per feature, 0 is missing)."""
    todo = [(root, np.arange(bins.shape[1]))]
    while todo:
        node, rows = todo.pop()
        f = forest.feature[node]
        if f < 0 or not len(rows):
            yield node, rows
            continue
        v = bins[f][rows]
        left = v <= math.floor(forest.threshold[node])
        if not forest.miss_left[node]:
            left &= v > 0
        todo += [(forest.left[node] + 1, rows[~left]), (forest.left[node], rows[left])]


def _added(forest: Forest, bins: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Margins ``m`` (a row per row) plus the values of the trees."""
    total = np.zeros_like(m)
    for root in forest.roots:
        for leaf, rows in _dealt(forest, root, bins):
            total[rows] += forest.value[leaf]
    return m + total


def _moved(pending: Forest):
    """The frame with the trees' values in its margins."""
    def run(batches):
        for pdf in batches:
            if len(pdf):
                bins = np.ascontiguousarray(_rows_of(pdf["bins"], np.int32).T)
                yield pdf.assign(m=_as_bytes(_added(pending, bins, _rows_of(pdf["m"], float))))
    return run


def _gradients(objective: str, m: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and hessians, a column per tree of a round, from margins and labels."""
    if objective == "regression":
        return m - y[:, None], np.ones_like(m)
    if objective == "binary":
        with np.errstate(over="ignore"):
            p = 1.0 / (1.0 + np.exp(-m))
        return p - y[:, None], p * (1.0 - p)
    e = np.exp(m - m.max(1, keepdims=True))
    p = e / e.sum(1, keepdims=True)
    return p - (np.arange(m.shape[1]) == y[:, None]), 2.0 * p * (1.0 - p)


def _leaves(forest: Forest, bins: np.ndarray, missing=lambda v: v == 0) -> np.ndarray:
    """The node that every row (first axis) reaches in every tree (second axis)."""
    feature, left = np.array(forest.feature), np.array(forest.left)
    threshold, miss_left = np.array(forest.threshold), np.array(forest.miss_left)
    at = np.tile(np.array(forest.roots), (len(bins), 1))
    rows = np.arange(len(bins))[:, None]
    while len(bins) and (feature[at] >= 0).any():
        f = feature[at]
        v = bins[rows, np.maximum(f, 0)]
        right = ~np.where(missing(v), miss_left[at], v <= threshold[at])
        at = np.where(f < 0, at, left[at] + right)
    return at


def _histograms(objective: str, pending: Forest, forest: Forest, is_open: list, columns: list, width: int):
    """Per task: sums of gradients, hessians and rows per (open node, feature,
    bin); margins are those of the frame plus the ``pending`` trees."""
    names = np.flatnonzero(is_open)
    place = np.cumsum(is_open) - 1

    def run(batches):
        total = None
        for pdf in batches:
            if not len(pdf):
                continue
            bins, m = np.ascontiguousarray(_rows_of(pdf["bins"], np.int32).T), _rows_of(pdf["m"], float)
            if pending.roots:
                m = _added(pending, bins, m)
            g, h = _gradients(objective, m, pdf["y"].to_numpy())
            d, same = len(bins), objective == "regression"  # there a hessian is a row
            size, found = len(names) * d * width, []
            for t, root in enumerate(forest.roots):
                at = np.full(len(pdf), -1)
                for leaf, rows in _dealt(forest, root, bins):
                    if is_open[leaf]:
                        at[rows] = place[leaf]
                rows = np.flatnonzero(at >= 0)
                if len(rows):
                    found.append((t, rows, at[rows], g[rows, t], None if same else h[rows, t]))
            if size <= HELD:
                total = np.zeros((3, len(names), d, width)) if total is None else total
                for t, rows, at, gt, ht in found:
                    for f in range(d) if columns[t] is None else columns[t]:
                        key = at * width + bins[f][rows]
                        for i, w in ((0, gt), (2, None), *(() if same else ((1, ht),))):
                            total[i, :, f] += np.bincount(key, w, len(names) * width).reshape(-1, width)
                continue
            keys, weights = [], []
            for t, rows, at, gt, ht in found:
                f = np.arange(d) if columns[t] is None else np.array(columns[t])
                keys.append(((at[:, None] * d + f) * width + bins[f][:, rows].T).ravel())
                ones = np.ones(len(rows))
                weights.append(np.repeat(np.stack([gt, ones if same else ht, ones]), len(f), axis=1))
            if keys:
                key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
                yield told(key, np.stack([np.bincount(inverse, w, len(key)) for w in np.concatenate(weights, axis=1)]), d)
        if total is not None:
            if same:
                total[1] = total[2]
            total = total.reshape(3, -1)
            key = np.flatnonzero(total[2])
            yield told(key, total[:, key], d)

    def told(key, sums, d):
        return pd.DataFrame({"node": names[key // (d * width)], "f": key // width % d, "b": key % width,
                             "g": sums[0], "h": sums[1], "n": sums[2].astype(np.int64)})
    return run


class _Growth:
    """The trees of one round while they grow (one per class)."""

    def __init__(self, trees: int):
        self.forest, self.best, self.tree = Forest(), {}, []
        for t in range(trees):
            self.forest.roots.append(self.forest.node([0.0], 0))
            self.tree.append(t)

    def expand(self, at: int) -> None:
        b = self.best[at]
        self.forest.split(at, b["f"], b["b"], b["miss_left"], [0.0], [0.0])
        self.tree += [self.tree[at]] * 2

    def chosen(self, num_leaves: int) -> list[int]:
        """Best gain first, per tree, as far as splits are known: nodes to be
        split, in that order (ties: the older node)."""
        out = []
        for root in self.forest.roots:
            heap, leaves = [(-self.gain(root), root)], 1
            while heap and leaves < num_leaves:
                g, at = heapq.heappop(heap)
                if not -g > 0.0:
                    break
                out.append(at)
                leaves += 1
                if self.forest.feature[at] >= 0:
                    for c in (self.forest.left[at], self.forest.left[at] + 1):
                        heapq.heappush(heap, (-self.gain(c), c))
        return out

    def gain(self, node: int) -> float:
        b = self.best.get(node)
        return b["gain"] if b is not None and b["gain"] is not None else -math.inf


def _leaf_score(g: str, h: str, alpha: float, lam: float) -> str:
    return f"coalesce(try_divide(pow(greatest(abs({g}) - {alpha!r}D, 0D), 2), {h} + {lam!r}D), 0D)"


def _leaf_value(g: float, h: float, alpha: float, lam: float) -> float:
    t = math.copysign(max(abs(g) - alpha, 0.0), g)
    return -t / (h + lam) if h + lam > 0 else 0.0


def best_splits(hist: DataFrame, p: dict) -> DataFrame:
    """(node, f, b, g, h, n) histogram -> one row per node: totals and the
    split of largest gain (``gain`` null if none is allowed; ties: the smaller
    feature, then bin, then missing values to the right).  Windows run over the
    bins of one (node, feature), at most ``max_bins`` + 1 rows."""
    part = "OVER (PARTITION BY node, f)"
    run = "OVER (PARTITION BY node, f ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    names = ("g", "h", "n")
    rows = hist.selectExpr(
        "node", "f", "b", *[f"sum({c}) {part} AS {c}_all" for c in names],
        *[f"sum(if(b > 0, {c}, 0)) {run} AS {c}_cum" for c in names],
        *[f"sum(if(b = 0, {c}, 0)) {part} AS {c}_miss" for c in names])
    without = "named_struct('ml', 0, " + ", ".join(f"'{c}', {c}_cum" for c in names) + ")"
    with_them = "named_struct('ml', 1, " + ", ".join(f"'{c}', {c}_cum + {c}_miss" for c in names) + ")"
    # without missing values both sides are the same split; with every present
    # value on the left, larger ones not seen in this node go there too
    cand = rows.selectExpr(
        "node", "f", f"if(n_miss > 0 AND n_cum = n_all - n_miss, {int(p['max_bins']) + 1}, b) AS b",
        *[f"{c}_all AS {c}" for c in names],
        f"explode(if(n_miss = 0, array({without}), array({without}, {with_them}))) AS s")
    a, lam, least, heavy = float(p["reg_alpha"]), float(p["reg_lambda"]), max(1, int(p["min_child_samples"])), \
        float(p["min_child_weight"])
    gain = (f"CASE WHEN b > 0 AND s.n >= {least} AND n - s.n >= {least} AND s.h >= {heavy!r}D AND h - s.h >= {heavy!r}D "
            f"THEN 0.5D * ({_leaf_score('s.g', 's.h', a, lam)} + {_leaf_score('(g - s.g)', '(h - s.h)', a, lam)} "
            f"- {_leaf_score('g', 'h', a, lam)}) - {float(p['gamma'])!r}D END")
    return cand.selectExpr("node", f"struct({gain} AS gain, -f AS f, -b AS b, -s.ml AS ml, s.g AS gl, s.h AS hl, "
                                   "s.n AS nl, g, h, n) AS c") \
        .groupBy("node").agg(F.max("c").alias("c")) \
        .selectExpr("node", "c.gain", "-c.f AS f", "-c.b AS b", "c.ml = -1 AS miss_left", "c.gl", "c.hl", "c.nl",
                    "c.g", "c.h", "c.n")


# What the second-order learners start from.
BOOST_DEFAULTS = {
    "n_estimators": 200, "learning_rate": 0.1, "max_depth": 6, "num_leaves": None, "subsample": 1.0,
    "colsample_bytree": 1.0, "reg_alpha": 0.0, "reg_lambda": 1.0, "gamma": 0.0, "min_child_weight": 1.0,
    "min_child_samples": 1, "max_bins": 255, "seed": 42,
}


def fit_boosting(train: DataFrame, objective: str, params: dict | None = None) -> ForestModel:
    """Second-order gradient boosting; ``train`` has ``features`` and ``label``.

    ``objective``: ``regression`` (squared error, from the mean), ``binary``
    (log loss on labels 0 / 1, from the log odds) or ``multiclass`` (softmax on
    labels 0 .. k - 1, one tree per class and round).  A leaf is worth
    ``-soft(G, reg_alpha) / (H + reg_lambda)`` times ``learning_rate``, a split
    half the gain in ``soft(G)^2 / (H + reg_lambda)`` minus ``gamma``.
    ``num_leaves`` grows the best leaf first: leaves that can still be among
    the chosen ones are evaluated together, so a tree costs about as many
    aggregations as it has levels.  ``max_depth`` below 1 means no limit (then
    ``num_leaves`` must be given).  Rows with a null label take no part; a null
    or NaN feature is a missing value.
    """
    p = {**BOOST_DEFAULTS, **(params or {})}
    if objective not in ("regression", "binary", "multiclass"):
        raise ValueError(f"parameter objective={objective!r} is not offered")
    depth = int(p["max_depth"]) if p["max_depth"] is not None and int(p["max_depth"]) >= 1 else None
    if depth is None and not p["num_leaves"]:
        raise ValueError("parameter num_leaves is needed where max_depth sets no limit")
    num_leaves = int(p["num_leaves"] or 2 ** depth)
    ship_package(train.sparkSession)
    rows = train.where(F.col("label").isNotNull()).select(
        vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"),
        F.monotonically_increasing_id().alias("id"))
    rows = cut_lineage(rows)  # ids are settled here: sampling is the same in every retry
    about = rows.agg(F.max(F.size("x")).alias("d"), F.avg("y").alias("mean"), F.max("y").alias("top")).first()
    if about["d"] is None:
        raise ValueError("no labelled rows to fit on")
    d = int(about["d"])
    k = max(2, int(about["top"]) + 1) if objective == "multiclass" else 1
    mean = float(about["mean"])
    if objective == "binary":
        inside = min(max(mean, 1e-9), 1.0 - 1e-9)
        base = [math.log(inside / (1.0 - inside))]
    else:
        base = [mean] if objective == "regression" else [0.0] * k
    edges = bin_edges(rows, "x", d, int(p["max_bins"]))
    frame = written(_binned(rows, edges, base))

    whole, pending = Forest(), Forest()
    rng = np.random.default_rng(int(p["seed"]))
    for r in range(int(p["n_estimators"])):
        if r and r % CHECKPOINT_ROUNDS == 0:
            if pending.roots:
                frame = written(frame.mapInPandas(_moved(pending), _FRAME))
            pending = Forest()
        cur = frame.select("bins", "id", "y", "m")
        if float(p["subsample"]) < 1.0:
            u = F.pmod(F.xxhash64(F.lit(int(p["seed"])), F.lit(r), "id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
            cur = cur.where(u < float(p["subsample"]))
        take = max(1, math.ceil(float(p["colsample_bytree"]) * d))
        columns = [sorted(rng.choice(d, take, replace=False).tolist()) if take < d else None for _ in range(k)]
        grown = _grow(cur.select("bins", "y", "m"), objective, pending, k, columns, depth, num_leaves, p)
        if not _append(grown, num_leaves, p, edges, k, whole, pending):
            break  # no tree of the round has a split or a value
    return ForestModel(whole, objective, k, base)


def _grow(rows: DataFrame, objective: str, pending: Forest, k: int, columns: list, depth: int | None,
          num_leaves: int, p: dict) -> _Growth:
    grown = _Growth(k)
    todo = list(grown.forest.roots)
    while todo:
        is_open = [False] * len(grown.forest.feature)
        for n in todo:
            is_open[n] = True
        hist = rows.mapInPandas(
            _histograms(objective, pending, grown.forest, is_open, columns, int(p["max_bins"]) + 2),
            "node int, f int, b int, g double, h double, n long").groupBy("node", "f", "b").agg(
            F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
        for row in best_splits(hist, p).collect():  # one row per open node
            grown.best[row["node"]] = row.asDict()
        todo = []
        for n in grown.chosen(num_leaves):
            if grown.forest.feature[n] < 0:
                grown.expand(n)
                left, lower = grown.forest.left[n], grown.forest.depth[n] + 1
                if depth is None or lower < depth:
                    todo += [left, left + 1]
    return grown


def _append(grown: _Growth, num_leaves: int, p: dict, edges: list, k: int,
            whole: Forest, pending: Forest) -> bool:
    """Add the chosen part of a round's trees to the model (thresholds as
    values) and to the pending forest (as bins)."""
    keep = set(grown.chosen(num_leaves))
    rate, alpha, lam = float(p["learning_rate"]), float(p["reg_alpha"]), float(p["reg_lambda"])
    moved = False

    def worth(g: float, h: float, t: int) -> list[float]:
        v = [0.0] * k
        v[t] = rate * _leaf_value(g, h, alpha, lam)
        return v

    for t, root in enumerate(grown.forest.roots):
        if root not in grown.best:
            continue  # no row of the sample
        top = worth(grown.best[root]["g"], grown.best[root]["h"], t)
        moved = moved or root in keep or abs(top[t]) > 1e-12
        for forest, by_value in ((whole, True), (pending, False)):
            start = forest.node(top, 0)
            forest.roots.append(start)
            stack = [(root, start)]
            while stack:
                old, new = stack.pop()
                if old not in keep:
                    continue
                b = grown.best[old]
                at = edges[b["f"]][b["b"] - 1] if by_value and b["b"] <= len(edges[b["f"]]) else \
                    (math.nan if by_value else b["b"])
                at = 1.7976931348623157e308 if at != at else at  # all present values go left
                child = forest.split(new, b["f"], at, b["miss_left"], worth(b["gl"], b["hl"], t),
                                     worth(b["g"] - b["gl"], b["h"] - b["hl"], t))
                stack += [(grown.forest.left[old], child), (grown.forest.left[old] + 1, child + 1)]
    return moved


# ---------------------------------------------------------------- extra trees

def unit_draw(seed: int, key: str) -> float:
    """``loomkit.functions.exprs.hash_unit`` of one key, on the driver."""
    return int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:8], 16) / 4294967296.0


def _subset(d: int, m: int, seed: int, name: str) -> list[int]:
    """``m`` of ``d`` features, those of smallest draw."""
    if m >= d:
        return list(range(d))
    return sorted(sorted(range(d), key=lambda f: unit_draw(seed, f"{name}:pick:{f}"))[:m])


def _packed(d: int, targets: list[str]):
    """Features, missing ones NaN, and targets of a batch as one matrix of bytes."""
    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            if all(v is not None and len(v) == d for v in pdf["x"]):
                x = np.concatenate(pdf["x"].to_numpy()).reshape(-1, d)
            else:
                x = np.full((len(pdf), d), np.nan)
                for i, v in enumerate(pdf["x"]):
                    if v is not None:
                        x[i, :len(v)] = v
            yield pd.DataFrame({"data": [np.hstack([x, pdf[targets].to_numpy(float)]).tobytes()]})
    return run


class _Level:
    """What the open nodes of a level draw: ``drawn`` features of each, all equally many."""

    def __init__(self, forest: Forest, drawn: dict, d: int):
        self.forest, self.d, self.nodes = forest, d, np.array(sorted(drawn))
        self.feature = np.array([drawn[n] for n in self.nodes])
        self.m = self.feature.shape[1]
        self.place = np.full(len(forest.feature), -1)
        self.place[self.nodes] = np.arange(len(self.nodes))

    def walked(self, pdf: pd.DataFrame):
        """Per chunk and tree: places of the open nodes, drawn values, and targets of the rows there."""
        for data in pdf["data"]:
            rows = np.frombuffer(data).reshape(-1, self.width)
            x, z = rows[:, :self.d], rows[:, self.d:]
            at = self.place[_leaves(self.forest, x, np.isnan)]
            for t in range(at.shape[1]):
                here = np.flatnonzero(at[:, t] >= 0)
                if len(here):
                    p = at[here, t]
                    yield p, x[here[:, None], self.feature[p]], z[here]

    def summed(self, batches, start, add, told):
        """``add`` over the batches of a task; a level too large to be held leaves it batch by batch."""
        total = None
        for pdf in batches:
            total = start() if total is None else total
            for found in self.walked(pdf):
                add(total, *found)
            if len(self.nodes) * self.m > HELD:
                yield told(total)
                total = None
        if total is not None:
            yield told(total)

    def named(self, key: np.ndarray) -> dict:
        return {"node": self.nodes[key // self.m], "i": key % self.m, "f": self.feature.ravel()[key]}

    def ranges(self, width: int):
        """Per task: smallest and largest value per (open node, drawn feature)."""
        self.width = width

        def add(total, p, v, z):
            key = (p[:, None] * self.m + np.arange(self.m)).ravel()
            np.fmin.at(total[0], key, v.ravel())
            np.fmax.at(total[1], key, v.ravel())

        def told(total):
            key = np.flatnonzero(~np.isnan(total[0]))
            return pd.DataFrame({**self.named(key), "low": total[0][key], "high": total[1][key]})

        return lambda batches: self.summed(
            batches, lambda: np.full((2, len(self.nodes) * self.m), np.nan), add, told)

    def sides(self, width: int, cuts: dict):
        """Per task: rows, squares and targets of each open node, and those left of each of its thresholds."""
        self.width, size = width, len(self.nodes) * self.m
        cut = np.array([[np.nan if c is None else c for c in cuts[n]] for n in self.nodes])

        def add(total, p, v, z):
            left = v <= cut[p]  # a missing value goes right
            weights = np.column_stack([np.ones(len(z)), (z * z).sum(1), z])
            row, slot = np.nonzero(left)
            key = p[row] * self.m + slot
            for i, w in enumerate(weights.T):
                total[0, i, ::self.m] += np.bincount(p, w, len(self.nodes))
                total[1, i] += np.bincount(key, w[row], size)

        def told(total):
            whole = np.repeat(total[0, :, ::self.m], self.m, axis=1)
            key = np.flatnonzero(~np.isnan(cut.ravel()) & (whole[0] > 0))
            out = {**self.named(key), "cut": cut.ravel()[key]}
            for name, sums in (("", whole), ("l", total[1])):
                out |= {f"n{name}": sums[0][key].astype(np.int64), f"q{name}": sums[1][key],
                        **{f"{name}z{c}": s[key] for c, s in enumerate(sums[2:])}}
            return pd.DataFrame(out)

        k = width - self.d
        return lambda batches: self.summed(batches, lambda: np.zeros((2, k + 2, size)), add, told)


def fit_extra_trees(train: DataFrame, classification: bool, n_estimators: int = 100, max_depth: int | None = None,
                    max_features: int | str | None = None, min_samples_leaf: int = 1, seed: int = 42) -> ForestModel:
    """Extremely randomised trees; ``train`` has ``features`` and ``label``.

    Every tree sees all rows.  Each node draws ``max_features`` features
    (``sqrt``, ``log2``, a number, or None for all) and for each one threshold
    ``low + u * (high - low)`` between its smallest and largest value in the
    node, ``u`` being a hash of seed, tree, node and feature; the split with
    the largest drop of Gini impurity (labels 0 .. k - 1) or variance is taken.
    A level of all trees is two aggregations: ranges, then sums left of the
    thresholds.  The driver holds the model and the open nodes' draws; a task
    holds one batch of rows and the sums of a level.  A node
    ends when pure, constant, at ``max_depth`` (None: 30) or smaller than twice
    ``min_samples_leaf``.  Rows with a null label take no part; a missing
    feature value goes right.
    """
    ship_package(train.sparkSession)
    rows = cut_lineage(train.where(F.col("label").isNotNull()).select(
        vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y")))
    about = rows.agg(F.max(F.size("x")).alias("d"), F.avg("y").alias("mean"), F.max("y").alias("top")).first()
    if about["d"] is None:
        raise ValueError("no labelled rows to fit on")
    d, mean = int(about["d"]), float(about["mean"])
    depth = 30 if max_depth is None else int(max_depth)
    m = {"sqrt": max(1, int(math.sqrt(d))), "log2": max(1, int(math.log2(d))) if d > 1 else 1}.get(
        str(max_features), d if max_features in (None, "all", "None") else max_features)
    m = min(d, max(1, int(m * d) if isinstance(m, float) and m <= 1.0 else int(m)))
    k = max(2, int(about["top"]) + 1) if classification else 1
    z = [F.when(F.col("y") == float(c), 1.0).otherwise(0.0) for c in range(k)] if classification \
        else [F.col("y") - F.lit(mean)]  # centred: sums of squares keep their digits
    rows = rows.select("x", *[c.alias(f"z{i}") for i, c in enumerate(z)])
    targets = [f"z{i}" for i in range(k)]
    square = sum((F.col(c) * F.col(c) for c in targets), F.lit(0.0))
    first = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(square).alias("q"),
                     *[F.sum(c).alias(c) for c in targets]).first()
    # plain rows: a batch packed into one value would make the readers and writers of tables hold thousands of them
    rows, packed = written(rows), _packed(d, targets)

    def scan(run, schema: str) -> DataFrame:
        return rows.mapInPandas(lambda batches: run(packed(batches)), schema)

    forest, name = Forest(), {}
    todo = []

    def enter(node: int, n: float, q: float, sums: list[float]) -> None:
        pure = q / n - sum((s / n) ** 2 for s in sums) <= 1e-12 * max(q / n, 1e-300)
        if not pure and forest.depth[node] < depth and n >= 2 * min_samples_leaf:
            todo.append(node)

    sums = [first[c] for c in targets]
    for t in range(n_estimators):
        root = forest.node([s / first["n"] for s in sums], 0)
        forest.roots.append(root)
        name[root] = f"{t}:1"
        enter(root, first["n"], first["q"], sums)
    while todo:
        level, todo[:] = list(todo), []
        drawn = {n: _subset(d, m, seed, name[n]) for n in level}
        now = _Level(forest, drawn, d)
        cuts: dict[int, list] = {n: [None] * len(drawn[n]) for n in level}
        for r in scan(now.ranges(d + k), "node int, i int, f int, low double, high double") \
                .groupBy("node", "i", "f").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
            if r["low"] < r["high"]:
                u = unit_draw(seed, f"{name[r['node']]}:{r['f']}")
                cuts[r["node"]][r["i"]] = r["low"] + u * (r["high"] - r["low"])
        sums = ["n", "nl", "q", "ql", *targets, *[f"l{c}" for c in targets]]
        sides = scan(now.sides(d + k, cuts), "node int, i int, f int, cut double, " + ", ".join(
            f"{c} {'long' if c in ('n', 'nl') else 'double'}" for c in sums)) \
            .groupBy("node", "f", "cut").agg(*[F.sum(c).alias(c) for c in sums])
        nr = F.col("n") - F.col("nl")
        score = sum((F.col(f"l{c}") ** 2 / F.col("nl") + (F.col(c) - F.col(f"l{c}")) ** 2 / nr for c in targets),
                    F.lit(0.0))
        sides = sides.where((F.col("nl") >= max(1, min_samples_leaf)) & (nr >= max(1, min_samples_leaf)))
        best = sides.groupBy("node").agg(F.max(F.struct(
            score.alias("score"), (-F.col("f")).alias("f"), "cut", "n", "nl", "q", "ql", *targets,
            *[f"l{c}" for c in targets])).alias("b")).select("node", "b.*")
        for r in sorted(best.collect(), key=lambda r: r["node"]):  # one row per open node
            n, at_node = r["n"], r["node"]
            ls = [r[f"l{c}"] for c in targets]
            rs = [r[c] - r[f"l{c}"] for c in targets]
            left = forest.split(at_node, -r["f"], r["cut"], False, [s / r["nl"] for s in ls],
                                [s / (n - r["nl"]) for s in rs])
            tree, heap = name[at_node].split(":")
            name[left], name[left + 1] = f"{tree}:{2 * int(heap)}", f"{tree}:{2 * int(heap) + 1}"
            enter(left, r["nl"], r["ql"], ls)
            enter(left + 1, n - r["nl"], r["q"] - r["ql"], rs)
    kind = "share" if classification else "regression"
    return ForestModel(forest, kind, k, [0.0] * k if classification else [mean], 1.0 / n_estimators)
