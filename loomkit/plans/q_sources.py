"""Queries for sources and sinks (survey 2.1): tables are written to a fresh
folder under the session's shared checkpoint folder and read back; the read
must equal the table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomkit.plans.registry import register
from loomkit.session import checkpoint_dir, load_table
from loomkit.sources import files as SRC


def scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/files/{name}-{uuid.uuid4().hex[:12]}"


_ORDERS_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"


def _roundtrip(spark, sf, fmt: str, sep: str = ",", suffix: str = ".csv"):
    o = load_table(spark, sf, "orders")
    root = scratch(spark, "orders") + suffix
    if fmt == "csv":
        o.write.option("header", True).option("sep", sep).csv(root)
    elif fmt == "parquet":
        o.write.parquet(root)
    elif fmt == "jsonl":
        o.write.json(root)
    return SRC.load_dataset(spark, root, schema=o.schema)


@register("read_delimited", _ORDERS_SQL)
def q_read_delimited(spark, sf):
    return _roundtrip(spark, sf, "csv", ",", ".csv")


@register("read_delimited_tsv", _ORDERS_SQL)
def q_read_delimited_tsv(spark, sf):
    return _roundtrip(spark, sf, "csv", "\t", ".tsv")


@register("read_parquet", _ORDERS_SQL)
def q_read_parquet(spark, sf):
    return _roundtrip(spark, sf, "parquet", suffix=".parquet")


@register("read_json", _ORDERS_SQL)
def q_read_json(spark, sf):
    return _roundtrip(spark, sf, "jsonl", suffix=".jsonl")


@register("load_dataset", """
SELECT suffix, (SELECT count(*) FROM orders) AS n_rows
FROM (VALUES ('.csv'), ('.tsv'), ('.parquet'), ('.pq'), ('.jsonl')) t(suffix)
UNION ALL SELECT '.xlsx', CAST(-1 AS BIGINT)""")
def q_load_dataset(spark, sf):
    """Suffix dispatch: the same table written in every format loads back
    whole; an unknown suffix is refused (row count -1)."""
    o = load_table(spark, sf, "orders")
    out = None
    for sfx, fmt, sep in [(".csv", "csv", ","), (".tsv", "csv", "\t"), (".parquet", "parquet", ","),
                          (".pq", "parquet", ","), (".jsonl", "jsonl", ",")]:
        df = _roundtrip(spark, sf, fmt, sep, sfx)
        r = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(sfx).alias("suffix"), "n_rows")
        out = r if out is None else out.unionByName(r)
    try:
        SRC.load_dataset(spark, f"{sf}/orders.xlsx")
        n = 0
    except ValueError:
        n = -1
    refused = o.agg(F.lit(n).cast("bigint").alias("n_rows")).select(
        F.lit(".xlsx").alias("suffix"), "n_rows")
    return out.unionByName(refused)


@register("write_table", """
SELECT l_orderkey AS run_id, l_returnflag AS name, CAST(l_quantity AS DOUBLE) AS value,
  l_linenumber AS step, CASE WHEN l_linestatus = 'F' THEN 'train' ELSE 'val' END AS phase FROM lineitem""")
def q_write_table(spark, sf):
    li = load_table(spark, sf, "lineitem")
    pts = li.select(F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("name"),
                    F.col("l_quantity").alias("value"), F.col("l_linenumber").alias("step"),
                    F.when(F.col("l_linestatus") == "F", "train").otherwise("val").alias("phase"))
    root = scratch(spark, "metric_points")
    # appended JSON lines partitioned by phase, written in two appends
    SRC.write_table(pts.where(F.col("step") <= 3), root, "json", "append", ["phase"])
    SRC.write_table(pts.where(F.col("step") > 3), root, "json", "append", ["phase"])
    back = spark.read.schema("run_id bigint, name string, value double, step int, phase string") \
        .json(root)
    return back


@register("read_reports", """
SELECT CAST(source AS VARCHAR) AS key, 'accuracy' AS metric,
  round(avg(CASE WHEN quality = CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END THEN 1.0 ELSE 0.0 END), 6) AS overall
FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY source""")
def q_read_reports(spark, sf):
    from loomkit.plans.q_fairness import _frame
    d = _frame(spark, sf)
    rep = d.groupBy("source").agg(F.avg((F.col("y") == F.col("p")).cast("double")).alias("o")) \
           .select("source", F.to_json(F.struct(F.lit("accuracy").alias("metric"),
                                                (F.round(F.col("o") * 1e6) / 1e6).alias("overall")))
                   .alias("value"))
    root = scratch(spark, "reports")
    rep.write.partitionBy("source").text(root)
    out = SRC.read_reports(spark, root, "metric string, overall double", r"source=([^/]+)/")
    return out.select("key", "report.metric", "report.overall")


@register("file_fingerprint")
def q_file_fingerprint(spark, sf):
    return SRC.file_fingerprint(spark, f"{sf}/*.parquet").select("name", "size_bytes", "sha256",
                                                                 "too_large")
