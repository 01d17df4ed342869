"""Prediction audit log and log lines, batch forms.

The audit log is an append-only table keyed by (deployment, received_at,
trace).  Summaries are window aggregates (``window()``) with approximate
quantiles (``percentile_approx``: bounded memory per group, no matter how hot
a deployment is).  Positions inside a quota bucket come from
``rank_within_groups`` (time slices of the bucket, offsets from a small
count table), never from a window over a whole hot bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomkit.functions.exprs import epoch_seconds, r6
from loomkit.operators.splits import rank_within_groups

PREVIEW_CHARS = 8192
RETENTION_DAYS = 90
QUEUE_CAP = 1000

# Quota rules (limit per window of seconds).
QUOTA_RULES = {"predict": (600, 60), "log_ingest": (2000, 60)}

TERMINAL_STATES = ("succeeded", "failed", "cancelled", "ready", "error")


def audit_record(df: DataFrame, deployment: str, received_at: str, latency: str, path: str,
                 status: str, trace: str, request_body: str, response_body: str,
                 audit_payloads: Column) -> DataFrame:
    """Build the audit event: latency rounded to 2, mode from the path,
    previews cut to 8192 chars when payload auditing is on, else byte counts."""
    def preview(body: str) -> Column:
        return F.when(audit_payloads, F.to_json(F.struct(
            F.substring(F.col(body), 1, PREVIEW_CHARS).alias("body")))) \
                .otherwise(F.to_json(F.struct(F.octet_length(F.col(body)).alias("bytes"))))
    return df.select(
        F.col(deployment).alias("deployment_id"),
        F.col(received_at).alias("received_at"),
        r6(F.col(latency), 2).alias("latency_ms"),
        F.when(F.col(path).endswith("/batch"), "batch").otherwise("online").alias("mode"),
        F.col(status).cast("int").alias("status_code"),
        F.col(trace).alias("trace_id"),
        preview(request_body).alias("input_preview_json"),
        preview(response_body).alias("output_preview_json"))


def audit_page(log: DataFrame, deployment_id, page: int = 1, page_size: int = 50) -> DataFrame:
    """Newest-first page of one deployment's events, with ``total``."""
    from loomkit.operators.ledger import list_page
    d = log.where(F.col("deployment_id") == F.lit(deployment_id))
    return list_page(d, [F.col("received_at").desc(), F.col("trace_id").desc()], page, page_size)


def audit_retention(log: DataFrame, now: Column, days: int = RETENTION_DAYS
                    ) -> tuple[DataFrame, DataFrame]:
    """(kept rows, counts of kept / dropped).  On a table partitioned by date
    the same predicate prunes whole partitions."""
    cutoff = now - F.make_dt_interval(F.lit(days))
    keep = F.col("received_at") >= cutoff
    tagged = log.withColumn("_keep", keep)
    counts = tagged.groupBy(F.when(F.col("_keep"), "kept").otherwise("dropped").alias("action")) \
                   .agg(F.count(F.lit(1)).alias("n"))
    return tagged.where("_keep").drop("_keep"), counts


def audit_latency_summary(log: DataFrame, window: str = "1 hour", slide: str | None = None,
                          accuracy: int = 10000) -> DataFrame:
    """Per deployment and time window: count, mean latency, p50 / p95
    (``percentile_approx``), error share (status >= 500).

    The mean is one division of the sum: latencies of a decimal type are summed
    exactly, doubles as doubles."""
    w = F.window("received_at", window, slide) if slide else F.window("received_at", window)
    g = log.groupBy("deployment_id", w.alias("w")).agg(
        F.count(F.lit(1)).alias("n"),
        F.try_divide(F.sum("latency_ms").cast("double"), F.count("latency_ms")).alias("avg_latency"),
        F.percentile_approx("latency_ms", 0.5, accuracy).cast("double").alias("p50_latency"),
        F.percentile_approx("latency_ms", 0.95, accuracy).cast("double").alias("p95_latency"),
        F.avg((F.col("status_code") >= 500).cast("double")).alias("error_share"))
    return g.select("deployment_id", F.col("w.start").alias("window_start"),
                    F.col("w.end").alias("window_end"), "n", "avg_latency",
                    "p50_latency", "p95_latency", "error_share")


def quota_fixed_window(requests: DataFrame, identity: str, ts: str, order_cols: list[str],
                       limit: int, window_seconds: int) -> DataFrame:
    """Fixed-window counting: bucket ``floor(epoch / w)``, the running position
    of each request in its (identity, bucket), ``over_limit`` past ``limit``
    and ``retry_after`` = w - epoch mod w for rejected requests (0 if accepted)."""
    epoch = epoch_seconds(ts)
    t = requests.withColumn("_epoch", epoch) \
                .withColumn("bucket", F.floor(F.col("_epoch") / window_seconds))
    u = F.pmod(F.col("_epoch"), F.lit(window_seconds)) / F.lit(float(window_seconds))
    ranked = rank_within_groups(t, [identity, "bucket"], u, [ts, *order_cols])
    over = F.col("_pos") + 1 > limit
    return ranked.select(
        *[c for c in requests.columns], "bucket", (F.col("_pos") + 1).alias("position"),
        over.alias("over_limit"),
        F.when(over, F.lit(window_seconds) - F.pmod(F.col("_epoch"), F.lit(window_seconds)))
        .otherwise(0).alias("retry_after"))


def queue_overflow(log: DataFrame, key: str, ts: str, order_cols: list[str], window: str,
                   cap: int = QUEUE_CAP) -> DataFrame:
    """Per key and time window: arrivals, kept (first ``cap``) and dropped."""
    w = F.window(ts, window)
    g = log.groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("w.start").alias("window_start"), "n",
                    F.least(F.col("n"), F.lit(cap)).alias("kept"),
                    F.greatest(F.col("n") - F.lit(cap), F.lit(0)).alias("dropped"))


LOG_JSON_SCHEMA = "ts string, level string, message string, msg string, _bad string"


def log_parse(lines: DataFrame, text: str = "value") -> DataFrame:
    """JSON line -> ts, level (lower-cased, default info), message (``message``
    or ``msg`` or the raw line, the first that is not empty); other text, broken
    JSON included -> level by ERROR / WARN keyword; blank lines skipped.  A
    missing ``ts`` stays NULL."""
    raw = F.trim(F.col(text))
    is_json = raw.startswith("{")
    parsed = F.from_json(F.when(is_json, raw), LOG_JSON_SCHEMA, {"columnNameOfCorruptRecord": "_bad"})
    said = lambda f: F.nullif(parsed[f], F.lit(""))
    up = F.upper(raw)
    kw = F.when(up.contains("ERROR"), "error").when(up.contains("WARN"), "warn").otherwise("info")
    ok_json = is_json & parsed.isNotNull() & parsed["_bad"].isNull()
    others = [c for c in lines.columns if c != text]
    return lines.where(raw != "").select(
        *others,
        F.when(ok_json, parsed["ts"]).alias("ts"),
        F.when(ok_json, F.lower(F.coalesce(said("level"), F.lit("info")))).otherwise(kw)
        .alias("level"),
        F.when(ok_json, F.coalesce(said("message"), said("msg"), raw)).otherwise(raw)
        .alias("message"))


def log_filter_tail(parsed: DataFrame, query: str, order_col: str, n: int) -> DataFrame:
    """Case-insensitive substring filter on message or level; the last ``n``."""
    q = F.lit(query.lower())
    hit = F.lower(F.col("message")).contains(q) | F.lower(F.col("level")).contains(q)
    return parsed.where(hit).orderBy(F.col(order_col).desc()).limit(n)


def status_transition(events: DataFrame, key: str, status: str, ts: str,
                      order_cols: list[str] | None = None,
                      terminal: tuple = TERMINAL_STATES) -> DataFrame:
    """Current status per key: the latest event, except that a terminal state
    is sticky (a later non-terminal event does not replace it)."""
    ordv = F.struct(F.col(ts), *[F.col(c) for c in (order_cols or [])])
    is_term = F.col(status).isin(list(terminal))
    g = events.groupBy(key).agg(
        F.max_by(F.col(status), ordv).alias("_latest"),
        F.max_by(F.when(is_term, F.col(status)), F.when(is_term, ordv)).alias("_term"),
        F.max(F.when(is_term, ordv)).alias("_term_at"),
        F.max(ordv).alias("_at"))
    return g.select(key, F.coalesce("_term", "_latest").alias("status"),
                    F.coalesce(F.col("_term_at")[ts], F.col("_at")[ts]).alias("since"))
