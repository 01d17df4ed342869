"""Queries for the prediction log and log lines (survey 2.11), batch forms.

Prediction log from events: deployment ``event_type``, received_at ``ts``,
latency ``value``, identity ``user_id``, trace ``event_id``, status 500 for
``error`` events else 200; the batch path for every 4th event; payload
auditing on for even users.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomkit.functions.exprs import with_scalars

from loomkit.operators import logs as LG
from loomkit.plans.registry import register
from loomkit.session import load_table

_LOG_SQL = """(SELECT event_type AS deployment_id, ts AS received_at, round(value, 2) AS latency_ms,
  CASE WHEN event_id % 4 = 0 THEN 'batch' ELSE 'online' END AS mode,
  CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code, event_id AS trace_id,
  CASE WHEN user_id % 2 = 0 THEN json_object('body', props)::VARCHAR
       ELSE json_object('bytes', octet_length(encode(props)))::VARCHAR END AS input_preview_json,
  CASE WHEN user_id % 2 = 0 THEN json_object('body', '{"label": "' || event_type || '"}')::VARCHAR
       ELSE json_object('bytes', octet_length(encode('{"label": "' || event_type || '"}')))::VARCHAR
  END AS output_preview_json, user_id
FROM events)"""


def request_frame(spark, sf):
    ev = load_table(spark, sf, "events")
    return ev.select(
        "event_type", "ts", "value", "user_id", "event_id", "props",
        F.when(F.col("event_id") % 4 == 0, "/predict/batch").otherwise("/predict").alias("path"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        F.concat(F.lit('{"label": "'), F.col("event_type"), F.lit('"}')).alias("response"))


def audit_log(spark, sf):
    rq = request_frame(spark, sf)
    rec = LG.audit_record(rq, "event_type", "ts", "value", "path", "status", "event_id", "props",
                          "response", F.col("user_id") % 2 == 0)
    return rec


@register("audit_record", f"""SELECT deployment_id, received_at, latency_ms, mode, status_code, trace_id,
  input_preview_json, output_preview_json FROM {_LOG_SQL}""")
def q_audit_record(spark, sf):
    return audit_log(spark, sf)


@register("audit_page", f"""
SELECT deployment_id, received_at, latency_ms, trace_id,
  (SELECT count(*) FROM {_LOG_SQL} WHERE deployment_id = 'click') AS total
FROM {_LOG_SQL} WHERE deployment_id = 'click'
ORDER BY received_at DESC, trace_id DESC LIMIT 20 OFFSET 20""")
def q_audit_page(spark, sf):
    log = audit_log(spark, sf).select("deployment_id", "received_at", "latency_ms", "trace_id")
    return LG.audit_page(log, "click", page=2, page_size=20)


@register("audit_retention", f"""
SELECT CASE WHEN received_at >= (SELECT max(received_at) FROM {_LOG_SQL}) - INTERVAL 7 DAY
  THEN 'kept' ELSE 'dropped' END AS action, count(*) AS n FROM {_LOG_SQL} GROUP BY 1""")
def q_audit_retention(spark, sf):
    log = audit_log(spark, sf)
    now = log.agg(F.max("received_at").alias("_now"))
    tagged = with_scalars(log, now)
    _kept, counts = LG.audit_retention(tagged, F.col("_now"), days=7)
    return counts


def _p_sql(p):
    return (f"(SELECT min(latency_ms) FILTER (WHERE rn >= ceil({p} * cnt)))")


@register("audit_latency_summary", f"""
WITH l AS (SELECT deployment_id, time_bucket(INTERVAL 1 HOUR, received_at) AS window_start,
             latency_ms, status_code FROM {_LOG_SQL}),
r AS (SELECT *, row_number() OVER (PARTITION BY deployment_id, window_start ORDER BY latency_ms) AS rn,
        count(*) OVER (PARTITION BY deployment_id, window_start) AS cnt FROM l)
SELECT deployment_id, window_start, window_start + INTERVAL 1 HOUR AS window_end, count(*) AS n,
  round(CAST(sum(CAST(latency_ms AS DECIMAL(38,10))) AS DOUBLE) / count(*), 4) AS avg_latency,
  min(latency_ms) FILTER (WHERE rn >= ceil(0.5 * cnt)) AS p50_latency,
  min(latency_ms) FILTER (WHERE rn >= ceil(0.95 * cnt)) AS p95_latency,
  round(avg(CASE WHEN status_code >= 500 THEN 1.0 ELSE 0.0 END), 6) AS error_share
FROM r GROUP BY deployment_id, window_start""", digits={"avg_latency": 4})
def q_audit_latency_summary(spark, sf):
    return LG.audit_latency_summary(_hundredths(audit_log(spark, sf)), "1 hour")


def _hundredths(log):
    """Latencies are recorded in hundredths: as decimals their sums are exact."""
    return log.withColumn("latency_ms", F.col("latency_ms").cast("decimal(18,2)"))


@register("quota_fixed_window", f"""
WITH r AS (SELECT user_id, event_id, ts, floor(epoch(ts) / 3600) AS bucket,
  row_number() OVER (PARTITION BY user_id, floor(epoch(ts) / 3600) ORDER BY ts, event_id) AS position,
  CAST(floor(epoch(ts)) AS BIGINT) AS e FROM events)
SELECT user_id, event_id, CAST(bucket AS BIGINT) AS bucket, position, position > 2 AS over_limit,
  CASE WHEN position > 2 THEN 3600 - e % 3600 ELSE 0 END AS retry_after FROM r""")
def q_quota_fixed_window(spark, sf):
    ev = load_table(spark, sf, "events").select("user_id", "event_id", "ts")
    out = LG.quota_fixed_window(ev, "user_id", "ts", ["event_id"], limit=2, window_seconds=3600)
    return out.select("user_id", "event_id", F.col("bucket").cast("bigint").alias("bucket"),
                      F.col("position").cast("bigint").alias("position"), "over_limit",
                      F.col("retry_after").cast("bigint").alias("retry_after"))


@register("queue_overflow", f"""
SELECT deployment_id, time_bucket(INTERVAL 1 DAY, received_at) AS window_start, count(*) AS n,
  least(count(*), 50) AS kept, greatest(count(*) - 50, 0) AS dropped
FROM {_LOG_SQL} GROUP BY deployment_id, time_bucket(INTERVAL 1 DAY, received_at)""")
def q_queue_overflow(spark, sf):
    out = LG.queue_overflow(audit_log(spark, sf), "deployment_id", "received_at", ["trace_id"],
                            "1 day", cap=50)
    return out.withColumn("kept", F.col("kept").cast("bigint")) \
              .withColumn("dropped", F.col("dropped").cast("bigint"))


_LINES_SQL = """(SELECT event_id AS line_no, CASE
  WHEN event_id % 50 = 0 THEN ''
  WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN '{"ts": "' || strftime(ts, '%Y-%m-%d %H:%M:%S')
       || '", "level": "' || upper(event_type) || '", "message": "user ' || CAST(user_id AS VARCHAR) || '"}'
  WHEN event_id % 3 = 0 THEN '{"level": "' || event_type || '", "msg": "value of ' || event_type || '"}'
  WHEN event_type = 'error' THEN 'ERROR request ' || CAST(event_id AS VARCHAR) || ' failed'
  WHEN event_type = 'click' THEN 'slow request warning ' || CAST(event_id AS VARCHAR)
  ELSE 'served ' || event_type || ' ' || CAST(event_id AS VARCHAR) END AS value FROM events)"""


def log_lines(spark, sf):
    ev = load_table(spark, sf, "events")
    eid = F.col("event_id")
    js1 = F.concat(F.lit('{"ts": "'), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
                   F.lit('", "level": "'), F.upper("event_type"), F.lit('", "message": "user '),
                   F.col("user_id").cast("string"), F.lit('"}'))
    js2 = F.concat(F.lit('{"level": "'), F.col("event_type"), F.lit('", "msg": "value of '),
                   F.col("event_type"), F.lit('"}'))
    line = (F.when(eid % 50 == 0, F.lit(""))
             .when((eid % 3 == 0) & (eid % 2 == 0), js1)
             .when(eid % 3 == 0, js2)
             .when(F.col("event_type") == "error",
                   F.concat(F.lit("ERROR request "), eid.cast("string"), F.lit(" failed")))
             .when(F.col("event_type") == "click",
                   F.concat(F.lit("slow request warning "), eid.cast("string")))
             .otherwise(F.concat(F.lit("served "), F.col("event_type"), F.lit(" "),
                                 eid.cast("string"))))
    return ev.select(eid.alias("line_no"), line.alias("value"))


_PARSED_SQL = f"""(SELECT line_no,
  CASE WHEN value LIKE '{{%' THEN json_extract_string(value, '$.ts') END AS ts,
  CASE WHEN value LIKE '{{%' THEN lower(coalesce(json_extract_string(value, '$.level'), 'info'))
       WHEN upper(value) LIKE '%ERROR%' THEN 'error' WHEN upper(value) LIKE '%WARN%' THEN 'warn'
       ELSE 'info' END AS level,
  CASE WHEN value LIKE '{{%' THEN coalesce(json_extract_string(value, '$.message'),
       json_extract_string(value, '$.msg'), value) ELSE value END AS message
FROM {_LINES_SQL} WHERE trim(value) <> '')"""


@register("log_parse", f"SELECT * FROM {_PARSED_SQL}")
def q_log_parse(spark, sf):
    return LG.log_parse(log_lines(spark, sf))


@register("log_filter_tail", f"""
SELECT * FROM {_PARSED_SQL} WHERE lower(message) LIKE '%request%' OR lower(level) LIKE '%request%'
ORDER BY line_no DESC LIMIT 100""")
def q_log_filter_tail(spark, sf):
    return LG.log_filter_tail(LG.log_parse(log_lines(spark, sf)), "REQUEST", "line_no", 100)


_STATUS_MAP_SQL = ("CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' "
                   "WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'succeeded' ELSE 'failed' END")


def status_events(spark, sf):
    ev = load_table(spark, sf, "events")
    st = (F.when(F.col("event_type") == "signup", "queued")
           .when(F.col("event_type").isin("view", "click"), "running")
           .when(F.col("event_type") == "purchase", "succeeded").otherwise("failed"))
    return ev.select("user_id", "event_id", "ts", st.alias("status"))


STATUS_TRANSITION_SQL = f"""
WITH s AS (SELECT user_id, event_id, ts, {_STATUS_MAP_SQL} AS status FROM events),
r AS (SELECT *, status IN ('succeeded', 'failed', 'cancelled', 'ready', 'error') AS term FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY term DESC, ts DESC, event_id DESC) AS rn
      FROM r)
SELECT user_id, status, ts AS since FROM o WHERE rn = 1"""


@register("status_transition", STATUS_TRANSITION_SQL)
def q_status_transition(spark, sf):
    return LG.status_transition(status_events(spark, sf), "user_id", "status", "ts", ["event_id"])


# ---------------------------------------------------------------- stream forms
# The events table file is the stream source (a folder scan filtered to that
# file); each query runs with availableNow into a checkpointed parquet sink
# and the sink is read back.  Stream results must equal the batch results.

def _event_stream(spark, sf):
    from loomkit.streaming.audit import file_stream
    schema = load_table(spark, sf, "events").schema
    return file_stream(spark, sf, schema, glob="events.parquet")


def _stream_log(spark, sf):
    ev = _event_stream(spark, sf)
    rq = ev.select(
        "event_type", "ts", "value", "user_id", "event_id", "props",
        F.when(F.col("event_id") % 4 == 0, "/predict/batch").otherwise("/predict").alias("path"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        F.concat(F.lit('{"label": "'), F.col("event_type"), F.lit('"}')).alias("response"))
    return LG.audit_record(rq, "event_type", "ts", "value", "path", "status", "event_id", "props",
                           "response", F.col("user_id") % 2 == 0)


@register("audit_ingest", f"""SELECT deployment_id, received_at, latency_ms, mode, status_code, trace_id
FROM {_LOG_SQL}""")
def q_audit_ingest(spark, sf):
    from loomkit.streaming.audit import audit_ingest, run_available
    out = run_available(audit_ingest(_stream_log(spark, sf)), "audit_ingest")
    return out.select("deployment_id", F.col("received_at").cast("timestamp_ntz").alias("received_at"),
                      "latency_ms", "mode", "status_code", "trace_id")


def _latency_sql() -> str:
    from loomkit.plans.registry import ORACLES
    return ORACLES["audit_latency_summary"]


@register("audit_latency_summary_stream", _latency_sql(), digits={"avg_latency": 4})
def q_audit_latency_summary_stream(spark, sf):
    from loomkit.streaming.audit import latency_summary_stream, run_available
    out = run_available(latency_summary_stream(_hundredths(_stream_log(spark, sf)), "1 hour", "2 hours"),
                        "latency_summary", mode="update", keys=["deployment_id", "window_start"])
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")) \
              .withColumn("window_end", F.col("window_end").cast("timestamp_ntz"))


@register("quota_fixed_window_stream", """
SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n,
  count(*) > 2 AS over_limit, greatest(count(*) - 2, 0) AS rejected
FROM events GROUP BY user_id, time_bucket(INTERVAL 1 HOUR, ts)""")
def q_quota_fixed_window_stream(spark, sf):
    from loomkit.streaming.audit import quota_window_stream, run_available
    ev = _event_stream(spark, sf).select("user_id", "event_id", "ts")
    out = run_available(quota_window_stream(ev, "user_id", "ts", "1 hour", "10 minutes", 2),
                        "quota", mode="update", keys=["user_id", "window_start"])
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")) \
              .withColumn("rejected", F.col("rejected").cast("bigint"))


@register("status_transition_stream", STATUS_TRANSITION_SQL)
def q_status_transition_stream(spark, sf):
    from loomkit.streaming.audit import run_available, status_stream
    ev = _event_stream(spark, sf)
    st = (F.when(F.col("event_type") == "signup", "queued")
           .when(F.col("event_type").isin("view", "click"), "running")
           .when(F.col("event_type") == "purchase", "succeeded").otherwise("failed"))
    events = ev.select("user_id", "event_id", "ts", st.alias("status"))
    final = run_available(status_stream(events, "user_id", "status", "ts", "event_id"),
                          "status", mode="update", keys=["key"])
    return final.select(F.col("key").cast("bigint").alias("user_id"), "status",
                        F.col("since").cast("timestamp_ntz").alias("since"))


_LATE_DELIVERIES = 3  # events arrive in three deliveries, by id


@register("audit_ingest_late", f"""
WITH e AS (SELECT event_id, ts, event_id % {_LATE_DELIVERIES} AS batch FROM events),
b AS (SELECT batch, count(*) AS arrived, max(ts) AS top FROM e GROUP BY batch),
w AS (SELECT batch, arrived, max(top) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        - INTERVAL 1 HOUR AS mark FROM b),
l AS (SELECT w.batch, w.arrived, count(*) FILTER (e.ts IS NULL OR e.ts < w.mark) AS late
      FROM w JOIN e USING (batch) GROUP BY ALL)
SELECT batch, arrived, arrived - late AS kept, 0::BIGINT AS repeated, late FROM l""")
def q_audit_ingest_late(spark, sf):
    """Three deliveries, the stream started anew for each on one checkpoint;
    what is behind the watermark of the deliveries before is in a side table."""
    from loomkit.streaming.audit import file_stream, ingest_counted, stream_folder
    ev = load_table(spark, sf, "events").select("event_id", "ts")
    root = stream_folder(spark, "audit_late")
    for i in range(_LATE_DELIVERIES):
        ev.where(F.col("event_id") % _LATE_DELIVERIES == i).write.parquet(f"{root}/inbox/{i}")
        stream = file_stream(spark, f"{root}/inbox", ev.schema, options={"recursiveFileLookup": "true"})
        out = ingest_counted(stream, f"{root}/log", "1 hour", trace="event_id", ts="ts")
    return out["counts"].select("batch", "arrived", "kept", "repeated", "late")


@register("stream_prediction_log", """SELECT event_id, ts, user_id, event_type, value, props FROM events""")
def q_stream_prediction_log(spark, sf):
    """Prediction events arrive as JSON-lines files; the stream appends them
    to the audit table (file source -> checkpointed parquet sink)."""
    from loomkit.plans.q_sources import scratch
    from loomkit.streaming.audit import file_stream, run_available
    ev = load_table(spark, sf, "events")
    inbox = scratch(spark, "prediction_inbox")
    micros = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    ev.write.options(**micros).json(inbox)  # the batches producers drop into the folder
    stream = file_stream(spark, inbox, ev.schema, fmt="json", options=micros)
    return run_available(stream, "prediction_log")
