"""Hyperparameter search: a seeded random trial table, fits run from a thread
pool (each trial is its own set of Spark jobs over the persisted feature
frame), results as a DataFrame; plus ranking of trials by metric direction."""

from __future__ import annotations

import json
import math
import random
import time
from concurrent.futures import ThreadPoolExecutor, as_completed

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomkit.operators.metrics import HIGHER_IS_BETTER

MAX_TRIALS = 500


def validate_space(space: dict, fixed: dict | None = None) -> None:
    if not space:
        raise ValueError("search space is empty")
    overlap = set(space) & set(fixed or {})
    if overlap:
        raise ValueError(f"parameters both searched and fixed: {sorted(overlap)}")


def sample_params(space: dict, n_trials: int = 30, seed: int = 42) -> list[dict]:
    """Seeded samples: int (step, log), float (log), categorical choices."""
    rng = random.Random(seed)
    out = []
    if not 1 <= n_trials <= MAX_TRIALS:
        raise ValueError(f"a search has 1 to {MAX_TRIALS} trials, not {n_trials}")
    for _ in range(n_trials):
        p = {}
        for name, spec in space.items():
            t = spec["type"]
            if t == "int":
                lo, hi, step = int(spec["low"]), int(spec["high"]), int(spec.get("step", 1))
                if spec.get("log"):
                    v = int(round(math.exp(rng.uniform(math.log(lo), math.log(hi)))))
                else:
                    v = lo + step * rng.randint(0, (hi - lo) // step)
                p[name] = max(lo, min(hi, v))
            elif t == "float":
                lo, hi = float(spec["low"]), float(spec["high"])
                p[name] = math.exp(rng.uniform(math.log(lo), math.log(hi))) if spec.get("log") \
                    else rng.uniform(lo, hi)
            elif t == "categorical":
                p[name] = rng.choice(list(spec["choices"]))
            else:
                raise ValueError(f"unknown parameter type {t!r}")
        out.append(p)
    return out


def hpo_search(model: str, task: str, train: DataFrame, val: DataFrame, space: dict,
               fixed: dict | None = None, metric: str | None = None, n_trials: int = 30,
               seed: int = 42, timeout: float = 1800.0, parallelism: int = 2):
    """Random search; returns (trials DataFrame, best params, best value)."""
    from loomkit.operators.supervised import fit_model

    validate_space(space, fixed)
    if metric is None:
        two = task != "regression" and train.select("label").distinct().limit(3).count() <= 2
        metric = "r2" if task == "regression" else "auroc" if two else "accuracy"
    up = HIGHER_IS_BETTER.get(metric, True)
    spark = train.sparkSession
    tr = train.persist(StorageLevel.MEMORY_AND_DISK)
    va = val.persist(StorageLevel.MEMORY_AND_DISK)
    trials = sample_params(space, n_trials, seed)
    start = time.time()
    rows = []

    def run(i, p):
        if time.time() - start > timeout:
            return i, p, None, "timeout"
        try:
            _m, mets, _ = fit_model(model, task, tr, va, {**(fixed or {}), **p})
            return i, p, float(mets.select(metric).first()[0]), "complete"
        except Exception as exc:  # noqa: BLE001 - a failed trial is recorded, not fatal
            return i, p, None, f"failed: {str(exc)[:200]}"

    try:
        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
            futs = [pool.submit(run, i, p) for i, p in enumerate(trials)]
            for f in as_completed(futs):
                rows.append(f.result())
    finally:
        tr.unpersist()
        va.unpersist()
    done = [r for r in rows if r[2] is not None]
    if not done:
        raise RuntimeError("no trial completed")
    best = min(done, key=lambda r: (-r[2] if up else r[2], r[0]))  # ties: the first trial
    table = spark.createDataFrame(
        [(i, json.dumps(p, sort_keys=True), v, s) for i, p, v, s in sorted(rows, key=lambda r: r[0])],
        "trial_id int, params string, value double, state string")
    return table, best[1], best[2]


def rank_trials(results: DataFrame, group_cols: list[str], metric_col: str, value_col: str,
                order_cols: list[str]) -> DataFrame:
    """Best row per (group, metric), direction by metric name.  The
    ``row_number() = 1`` filter keeps one row per group and map task before
    the shuffle (``WindowGroupLimit``)."""
    up = F.create_map(*[x for k, v in HIGHER_IS_BETTER.items() for x in (F.lit(k), F.lit(v))])
    signed = F.when(F.coalesce(up[F.col(metric_col)], F.lit(True)), F.col(value_col)) \
              .otherwise(-F.col(value_col))
    w = Window.partitionBy(*group_cols, metric_col).orderBy(
        signed.desc(), *[F.col(c) for c in order_cols])
    return results.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
