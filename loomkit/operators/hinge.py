"""Support vector classifier over random Fourier waves that are never stored.

``LinearSVC`` on the waves keeps 256 doubles a row and reads them again in
each step.  Here a row keeps its features; a pass makes the waves of a few
hundred rows at a time and adds up loss and gradient in the task.  Objective,
standardization, steps and defaults are those of ``LinearSVC`` (hinge loss
with an L2 term, ``OneVsRest`` above two classes), so the fit is its fit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from numpy.polynomial import Chebyshev, Polynomial
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomkit.session import ship_package, written

ROWS = 128  # rows whose waves are made together: they fit a core's cache
STEPS = 100  # fixed value: most steps, as in LinearSVC

# cos(pi r) for |r| <= 1/2 as a polynomial in r^2, to 1e-12
_COS = Chebyshev.interpolate(lambda u: np.cos(np.pi * np.sqrt(np.maximum(u, 0.0))), 6, domain=[0.0, 0.25]) \
    .convert(kind=Polynomial, domain=[-1, 1], window=[-1, 1]).coef


def turns(w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Frequencies with the phases below them, in turns: for rows ending in a 1."""
    return np.vstack([w, b]) / (2.0 * np.pi)


def space(t: np.ndarray) -> np.ndarray:
    """Where ``squares`` works: made once a task, as fresh arrays cost as much as the arithmetic."""
    return np.empty((2, ROWS, t.shape[1]))


def squares(x: np.ndarray, t: np.ndarray, held: np.ndarray) -> np.ndarray:
    """``cos^2(pi x t)``, the half of ``1 + cos(2 pi x t)``, for up to ``ROWS`` rows, several times
    faster than ``np.cos``.  The result lies in ``held``, until the next call."""
    r, out = held[:, :len(x)]
    np.matmul(x, t, out=r)
    np.rint(r, out=out)
    r -= out
    r *= r
    np.multiply(r, _COS[-1], out=out)
    out += _COS[-2]
    for c in _COS[-3::-1]:
        out *= r
        out += c
    out *= out
    return out


def _packed(classes: int):
    """Features, a 1 and the label of a batch as one matrix of bytes."""
    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            y = pdf["y"].to_numpy(float)
            if not np.isfinite(y).all():
                raise ValueError("Labels MUST NOT be Null or NaN")
            if ((y < 0) | (y >= classes) | (y != np.rint(y))).any():
                raise ValueError(f"Labels MUST be in 0 .. {classes - 1}")
            x = np.vstack(pdf["x"].to_numpy())
            if not np.isfinite(x).all():
                raise ValueError("Vectors MUST NOT contain NaN or Infinity")
            yield pd.DataFrame({"data": [np.column_stack([x, np.ones(len(x)), y]).tobytes()]})
    return run


def _chunks(batches, width: int):
    for pdf in batches:
        for data in pdf["data"]:
            rows = np.frombuffer(data).reshape(-1, width)
            for at in range(0, len(rows), ROWS):
                yield rows[at:at + ROWS, :-1], rows[at:at + ROWS, -1]


def _merged(parts) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and squared deviations of all parts."""
    n, mean, dev = 0, 0.0, 0.0
    for k, m, d in parts:
        gap = np.asarray(m) - mean
        dev = dev + d + gap * gap * (n * k / (n + k))
        mean = mean + gap * (k / (n + k))
        n += k
    return n, mean, dev


def _spread(t: np.ndarray):
    """A task's count, means and squared deviations of the squares."""
    def run(batches):
        held = space(t)

        def parts():
            for x, _y in _chunks(batches, len(t) + 1):
                q = squares(x, t, held)
                m = q.mean(axis=0)
                q -= m
                yield len(x), m, (q * q).sum(axis=0)
        n, mean, dev = _merged(parts())
        if n:
            yield pd.DataFrame({"n": [n], "mean": [mean], "dev": [dev]})
    return run


def _hinge(t: np.ndarray, a: np.ndarray, offset: float, positive: float):
    """A task's sums for the margins ``squares @ a + offset``: loss, multipliers, multipliers times squares."""
    def run(batches):
        held, loss, hits, g = space(t), 0.0, 0.0, np.zeros(len(a))
        for x, label in _chunks(batches, len(t) + 1):
            q = squares(x, t, held)
            y = np.where(label == positive, 1.0, -1.0)
            short = 1.0 - y * (q @ a + offset)
            inside = short > 0
            up = np.where(inside, -y, 0.0)
            loss += short[inside].sum()
            hits += up.sum()
            g += up @ q
        yield pd.DataFrame({"loss": [loss], "hits": [hits], "g": [g]})
    return run


class _Waves:
    """The training rows, packed, and the spread of their waves ``scale * cos(x w + b)``."""

    def __init__(self, train: DataFrame, w: np.ndarray, b: np.ndarray, scale: float, classes: int):
        spark = train.sparkSession
        ship_package(spark)
        self.t, self.scale = turns(w, b), scale
        packed = train.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y")) \
            .mapInPandas(_packed(classes), "data binary")
        # dealt out: an input of few files would leave every pass to few tasks
        self.rows = written(packed.repartition(3 * spark.sparkContext.defaultParallelism))
        parts = self.rows.mapInPandas(_spread(self.t), "n long, mean array<double>, dev array<double>").collect()
        self.n, mean, dev = _merged((r["n"], np.array(r["mean"]), np.array(r["dev"])) for r in parts)
        std = np.sqrt(dev / max(self.n - 1, 1))
        std[std < 1e-12] = 0.0  # the same wave in every row, but for rounding
        std *= 2.0 * scale
        self.inverse = np.divide(1.0, std, out=np.zeros_like(std), where=std > 0)
        self.mean = self.inverse * scale * (2.0 * mean - 1.0)

    def plain(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """Weights of the squares and offset for standardized coefficients and intercept."""
        c = x[:-1] * self.inverse * self.scale
        return 2.0 * c, float(x[-1] - x[:-1] @ self.mean - c.sum())

    def objective(self, reg: float, positive: float):
        def f(x: np.ndarray) -> tuple[float, np.ndarray]:
            a, offset = self.plain(x)
            parts = self.rows.mapInPandas(_hinge(self.t, a, offset, positive),
                                          "loss double, hits double, g array<double>").collect()
            loss, hits = sum(r["loss"] for r in parts), sum(r["hits"] for r in parts)
            g = np.sum([r["g"] for r in parts], axis=0)
            waves = self.scale * (2.0 * g - hits)
            grad = np.append(waves * self.inverse - self.mean * hits, hits) / self.n
            grad[:-1] += reg * x[:-1]
            return loss / self.n + 0.5 * reg * float(x[:-1] @ x[:-1]), grad
        return f


class _Stuck(Exception):
    """No step along this direction."""


def _direction(grad: np.ndarray, memory: list) -> np.ndarray:
    """L-BFGS direction from (step, change of gradient) pairs, latest first."""
    out = grad.copy()
    if memory:
        s, y = memory[0]
        with np.errstate(all="ignore"):
            shrink = (s @ y) / (y @ y)
            told = [s @ y for s, y in memory]
            used = []
            for (s, y), r in zip(memory, told):
                used.append((s @ out) / r)
                out -= used[-1] * y
            out *= shrink
            for (s, y), r, u in reversed(list(zip(memory, told, used))):
                out += (u - (y @ out) / r) * s
        if not shrink >= 0 or not np.isfinite(used).all():
            raise _Stuck
    return np.where(out * grad > 0, -out, 0.0)


def _step(f, value: float, slope: float, alpha: float, shrink: float) -> float:
    """Backtracking until the Wolfe conditions hold, 20 tries.

    The optimizer judges the first try by the value it starts from, so a step
    that should gain anything is cut once before ``f`` is asked."""
    v, d = value, None
    for _ in range(20):
        if v > value + alpha * slope * 1e-4:
            times = shrink
        else:
            d = f(alpha)[1] if d is None else d
            if d < 0.9 * slope:
                times = 2.1
            elif d > -0.9 * slope:
                times = shrink
            else:
                return alpha
        last, alpha = alpha, alpha * times
        if not 1e-10 <= alpha <= 1e10:
            raise _Stuck
        v, d = f(alpha)
    return last


def minimized(f, x: np.ndarray, max_iter: int, tol: float = 1e-6, held: int = 10) -> np.ndarray:
    """The steps of the optimizer of ``LinearSVC`` (OWLQN without an L1 term:
    L-BFGS kept to the orthant of each point) for ``f(x) -> (value, gradient)``."""
    done: dict = {}

    def at(p):
        if p.tobytes() != done.get("p"):
            done.update(p=p.tobytes(), v=f(p))
        return done["v"]

    value, grad = at(x)
    first, values, memory, failed = abs(value), [value], [], False
    for i in range(max_iter):
        if len(values) > 1 and abs(value - max(values)) <= tol * first \
                or np.linalg.norm(grad) <= max(tol * value, 1e-8):
            break
        while True:
            try:
                way = _direction(grad, memory)
                side = np.where(x != 0, np.sign(x), np.sign(-grad))

                def moved(alpha, x=x, way=way, side=side):
                    p = x + alpha * way
                    return np.where(np.sign(p) == side, p, 0.0)

                def along(alpha, moved=moved, way=way):
                    v, g = at(moved(alpha))
                    return v, float(g @ way)

                alpha = _step(along, value, float(grad @ way), 0.5 / np.linalg.norm(grad) if i < 1 else 1.0,
                              0.1 if i < 1 else 0.5)
                break
            except _Stuck:
                if failed:
                    return x
                failed, memory = True, []
        failed = False
        now = moved(alpha)
        v, g = at(now)
        memory = [(now - x, g - grad), *memory][:held]
        x, value, grad = now, v, g
        values = [*values, value][-held:]
    return x


class WaveSvcModel(Model):
    """One classifier over the waves, or one per class (largest margin)."""

    def __init__(self, t: np.ndarray, a: np.ndarray, offset: np.ndarray):
        super().__init__()
        self.t, self.a, self.offset = t, a, offset

    def _transform(self, df: DataFrame) -> DataFrame:
        ship_package(df.sparkSession)
        t, a, offset = self.t, self.a, self.offset

        @F.pandas_udf("raw array<double>, prediction double")
        def scored(x: pd.Series) -> pd.DataFrame:
            if not len(x):
                return pd.DataFrame({"raw": pd.Series([], dtype=object), "prediction": pd.Series([], dtype=float)})
            rows = np.vstack(x.to_numpy())
            rows = np.column_stack([rows, np.ones(len(rows))])
            held = space(t)
            m = np.vstack([squares(rows[i:i + ROWS], t, held) @ a for i in range(0, len(rows), ROWS)]) + offset
            if m.shape[1] == 1:
                return pd.DataFrame({"raw": list(np.hstack([-m, m])), "prediction": (m[:, 0] > 0).astype(float)})
            return pd.DataFrame({"raw": list(m), "prediction": m.argmax(axis=1).astype(float)})

        got = df.withColumn("_svc", scored(vector_to_array("features")))
        return got.withColumns({"rawPrediction": array_to_vector(F.col("_svc.raw")),
                                "prediction": F.col("_svc.prediction")}).drop("_svc")


def fit_wave_svc(train: DataFrame, w: np.ndarray, b: np.ndarray, scale: float, reg: float,
                 classes: int) -> WaveSvcModel:
    """Fit on ``features`` and ``label`` (0 .. ``classes`` - 1)."""
    waves = _Waves(train, w, b, scale, classes)
    found = [waves.plain(minimized(waves.objective(reg, c), np.zeros(w.shape[1] + 1), STEPS))
             for c in ([1.0] if classes <= 2 else np.arange(float(classes)))]
    return WaveSvcModel(waves.t, np.column_stack([a for a, _ in found]), np.array([o for _, o in found]))
