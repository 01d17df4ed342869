"""Shared helpers of the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkit.session import checkpoint_dir, load_table, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query of this subpackage, with its DuckDB oracle if it has one."""
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return load_table(spark, sf_dir, name)


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path under the folder that driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as parquet into the shared folder and read it back.

    Cuts the lineage for good: a lost executor loses nothing, and several
    readers do not repeat the work above.
    """
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8.

    ``bytes.split`` cuts at exactly those six white-space bytes, and no byte
    of a longer UTF-8 sequence is one of them.
    """
    return text.encode("utf-8", "surrogatepass").split()


_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser over ``uint64`` arrays."""
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def windows64(codes: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit code for every run of ``width`` consecutive word codes."""
    n = len(codes) - width + 1
    if n <= 0:
        return codes[:0]
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + codes[i:i + n])
    return out


def text_chunks(batches: Iterator[pd.DataFrame], text: str = "text",
                chars: int = 500_000) -> Iterator[pd.DataFrame]:
    """Cut Arrow batches so that one piece holds about ``chars`` characters.

    Bounds the memory of a Python worker whatever the batch size; one longer
    text is a piece of its own.
    """
    for pdf in batches:
        pdf = pdf.reset_index(drop=True)
        size = pdf[text].str.len().fillna(0).to_numpy(np.int64)
        piece = np.cumsum(size) // chars
        for lo, hi in zip(*_runs(piece)):
            yield pdf.iloc[lo:hi].reset_index(drop=True)


def _runs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(a):
        return a, a
    cut = np.flatnonzero(np.diff(a)) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(a)]])


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan, dealt evenly over the shuffle partitions when the scan
    has fewer tasks than the cluster has slots (one large row group)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8"))
    return df.repartition(parts) if df.rdd.getNumPartitions() < 2 else df

