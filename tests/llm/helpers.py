"""Small frames with the awkward rows every operator must take."""

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, rows):
    """Documents from ``(doc_id, text)`` or ``(doc_id, text, lang, source)``, with
    extra columns whose names clash with the operators' own."""
    full = [(r + ("en", "src0"))[:4] + (len(r[1] or ""),) for r in rows]
    return spark.createDataFrame(full, DOCS).withColumns(
        {c: F.lit("clash") for c in ("doc", "n", "ids", "part", "kept", "digest", "band", "comp", "text_post", "rest")})


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=repr)
