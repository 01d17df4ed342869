"""Batch scoring: append predictions to the input rows (partitions replace
the reference's 1000-row chunks), decode class labels, cluster ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomkit.operators.transforms import decode_label


def score_batch(model, df: DataFrame, prepare=None, output: str = "prediction") -> DataFrame:
    """Input rows + ``prediction``; an input column already named
    ``prediction`` makes the new one ``prediction_pred``."""
    clash = output in df.columns
    src = df.withColumnRenamed(output, "_orig_" + output) if clash else df
    scored = model.transform(prepare(src) if prepare else src)
    keep = [c for c in src.columns] + [output]
    out = scored.select(*keep)
    if clash:
        out = out.withColumnRenamed(output, f"{output}_pred") \
                 .withColumnRenamed("_orig_" + output, output)
    return out


def score_with_labels(scored: DataFrame, classes: list[str], encoded: bool,
                      pred: str = "prediction") -> DataFrame:
    return scored.withColumn("label", decode_label(F.col(pred), classes, encoded))
