"""Registered queries: one per operator key, each with its DuckDB oracle.

Every query reads the driver tables (whole tables, no row caps) and calls the
library operator; the oracle is an independent SQL statement of the same
result.  Floats are rounded (6 digits, or 2 for large money sums) in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkit.functions.exprs import r6

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: int | dict[str, int]) -> DataFrame:
    """Double columns rounded for comparison with the oracle; operators never
    round.  ``digits`` holds for all of them, or per column (6 elsewhere)."""
    per = digits if isinstance(digits, dict) else {}
    least = 6 if per else digits
    return df.select(*[r6(c, per.get(c, least)).alias(c) if t == "double" else F.col(c)
                       for c, t in df.dtypes])


def register(name: str, sql: str | None = None, digits: int | dict[str, int] | None = None):
    def deco(fn):
        QUERIES[name] = fn if digits is None else (
            lambda spark, sf: rounded(fn(spark, sf), digits))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def sql_hash(seed: int, key_sql: str) -> str:
    """DuckDB form of ``loomkit.functions.hash_unit``."""
    return (f"((('0x' || substr(md5('{seed}:' || CAST({key_sql} AS VARCHAR)), 1, 8))::BIGINT)"
            f" / 4294967296.0::DOUBLE)")


QUERY_MODULES = ("q_profile", "q_splits", "q_transforms", "q_metrics", "q_ledger",
                 "q_fairness", "q_series", "q_reco", "q_clusters", "q_logs", "q_sources",
                 "q_models")


def load_all() -> None:
    """Import every module that registers queries."""
    import importlib
    import importlib.util

    for m in QUERY_MODULES:
        name = f"loomkit.plans.{m}"
        if importlib.util.find_spec(name) is not None:
            importlib.import_module(name)
