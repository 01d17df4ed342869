"""Declarative feature planning: ``{column, op, params}`` entries + defaults
-> fitted ops -> one projection (+ ``VectorAssembler``).

Planning is plain Python over the column list; all data work is the single
aggregate pass of ``fit_ops`` and the projection of ``apply_ops``.  Several
entries on one column are parallel branches (each reads the raw column), as
in the reference; the branch key keeps their outputs apart.
"""

from __future__ import annotations

import re

from pyspark.ml import Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomkit.operators.transforms import ColumnOp, fit_ops, with_codes

# Default op per coarse type for columns no entry touches.
DEFAULT_OP = {"numeric": "passthrough", "boolean": "passthrough", "categorical": "one_hot",
              "datetime": "date_features"}

_TRANSFORM_REGISTRY: dict[str, type] = {}


def register_transform(name: str, factory) -> None:
    """Extension point: ``factory(column, params)`` returning a ``ColumnOp``-like object."""
    _TRANSFORM_REGISTRY[name] = factory


def plan_ops(transforms: list[dict], schema: dict[str, str]) -> tuple[list[ColumnOp], list[str]]:
    """Entries + defaults -> ordered ops and the kept input columns."""
    ops: list[ColumnOp] = []
    touched, dropped = set(), set()
    for idx, entry in enumerate(transforms):
        col, op = entry["column"], str(entry["op"]).lower()
        params = entry.get("params") or {}
        touched.add(col)
        if op == "drop":
            dropped.add(col)
            continue
        if op in _TRANSFORM_REGISTRY:
            ops.append(_TRANSFORM_REGISTRY[op](col, params))
            continue
        ops.append(ColumnOp(col, op, params, key=f"{idx}_{op}_{col}"))
    rest = [c for c in schema if c not in touched and c not in dropped]
    num = [c for c in rest if schema[c] in ("numeric", "boolean")]
    cat = [c for c in rest if schema[c] == "categorical"]
    dt = [c for c in rest if schema[c] == "datetime"]
    ops += [ColumnOp(c, "passthrough", {}, key="auto_passthrough") for c in num]
    ops += [ColumnOp(c, "one_hot", {}, key="auto_onehot") for c in cat]  # code columns add the column's name
    ops += [ColumnOp(c, "date_features", {}, key=f"auto_datefeat_{c}") for c in dt]
    if not ops:
        raise ValueError("the feature plan keeps no column")
    kept = [o.column for o in ops]
    return ops, kept


def _safe(name: str) -> str:
    return re.sub(r"[^0-9A-Za-z_]", "_", name)


class FeatureModel(Transformer):
    """Fitted feature plan: a projection plus an optional vector assembly."""

    def __init__(self, ops: list[ColumnOp], kept: list[str]):
        super().__init__()
        self.ops = ops
        self.kept = kept
        self.branch_names = [f"{o.key}__{n}" for o in ops for n, _ in o.outputs()]
        self.feature_names = [n for o in ops for n, _ in o.outputs()]

    def columns(self, short_names: bool = False) -> list:
        out = []
        for o in self.ops:
            for n, e in o.outputs():
                out.append(e.alias(_safe(n) if short_names else _safe(f"{o.key}__{n}")))
        return out

    def _transform(self, df: DataFrame, keep: list[str] | None = None,
                   assemble: bool = True, short_names: bool = False) -> DataFrame:
        df = with_codes(df, self.ops)
        proj = df.select(*[F.col(c) for c in (keep or [])], *self.columns(short_names))
        if not assemble:
            return proj
        names = [_safe(n) for n in (self.feature_names if short_names else self.branch_names)]
        va = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep")
        return va.transform(proj)


def build_feature_pipeline(train: DataFrame, transforms: list[dict],
                           schema: dict[str, str]) -> FeatureModel:
    """Fit the declarative plan on ``train`` (one aggregate pass)."""
    from pyspark import StorageLevel

    ops, kept = plan_ops(transforms, schema)
    # the fit makes up to three passes (statistics, date scaling, categories):
    # keep only the used columns, once, spilling to disk if memory is short
    cols = train.select(*sorted(set(kept))).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fit_ops(cols, ops)
    finally:
        cols.unpersist()
    return FeatureModel(ops, kept)


def build_feature_frame(train: DataFrame, apply_to: DataFrame, transforms: list[dict],
                        schema: dict[str, str], keep: list[str] | None = None,
                        assemble: bool = True, short_names: bool = False) -> DataFrame:
    model = build_feature_pipeline(train, transforms, schema)
    return model._transform(apply_to, keep=keep, assemble=assemble, short_names=short_names)
