"""Training-corpus pipeline over ``documents``: language ID, quality rules,
near-duplicate removal, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``documents``.  No stage is expressible in SQL as a
whole (token ids, signatures), so ``ORACLE_SQL`` is None and the tests hold
``run`` against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkit.llm.common import materialise, table
from loomkit.llm.langid import keep_known
from loomkit.llm.minhash import keep_one
from loomkit.llm.packing import pack_documents
from loomkit.llm.quality import keep_good
from loomkit.session import ship_package

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the fused evidence tells."""
    ship_package(spark)
    return keep_known(docs, declared=F.col("lang"), host=F.col("source"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their language's fertility bands."""
    ship_package(spark)
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies (five words, 0.8)."""
    ship_package(spark)
    return keep_one(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed token stream."""
    ship_package(spark)
    return pack_documents(docs).drop("ids")


STAGES = [("language_id", language_id), ("quality_rules", quality_rules),
          ("near_dedup", near_dedup), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
