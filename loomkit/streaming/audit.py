"""Structured Streaming forms of the prediction log operators.

Sources are file streams (new files in a folder are new micro-batches);
sinks are parquet tables written with a checkpoint, so a restarted or
partially failed query resumes exactly where it stopped.  Event time gets a
watermark (ours: the reference has none) that bounds the state of
de-duplication, windows and keyed status.

``run_available`` drives a query with ``trigger(availableNow=True)`` and
returns the sink read back as a batch DataFrame; both folders live under the
session's shared checkpoint folder.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomkit.operators import logs as LG
from loomkit.session import checkpoint_dir, ship_package


def stream_folder(spark: SparkSession, name: str) -> str:
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/streams/{name}-{uuid.uuid4().hex[:12]}"


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, glob: str | None = None,
                fmt: str = "parquet", max_files: int | None = None,
                options: dict | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format(fmt).options(**(options or {}))
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(folder)


def run_available(df: DataFrame, name: str, mode: str = "append",
                  keys: list[str] | None = None,
                  partition_by: list[str] | None = None, root: str | None = None) -> DataFrame:
    """Run a streaming frame over the available input into a checkpointed
    parquet sink; return the result as a batch frame.

    ``append``: the file sink itself.  ``update`` (windows still open at the
    end of input, keyed state): every micro-batch's changed rows are appended
    with their batch id through ``foreachBatch`` (re-running a batch after a
    failure rewrites the same rows), and the read-back keeps the newest row
    per ``keys``.

    ``root`` is the folder of sink and checkpoint: a later call with the same
    one resumes behind the input already read; without it each call starts anew.
    """
    spark = df.sparkSession
    root = root or stream_folder(spark, name)
    w = df.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/_checkpoint") \
          .trigger(availableNow=True)
    if mode == "append":
        w = w.format("parquet")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.start(f"{root}/data").awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{root}/data")
    if not keys:
        raise ValueError("update mode needs the key columns of the result")
    data = f"{root}/data"

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("append").parquet(data)

    w.foreachBatch(write_batch).start().awaitTermination()
    out_schema = T.StructType(df.schema.fields + [T.StructField("_batch", T.LongType())])
    spark.createDataFrame([], out_schema).write.mode("append").parquet(data)  # there is a table if no batch had rows
    rows = spark.read.schema(out_schema).parquet(data)
    others = [c for c in df.columns if c not in keys]
    latest = rows.groupBy(*keys).agg(
        F.max_by(F.struct(*others), F.col("_batch")).alias("_row"))
    return latest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others])


def as_event_time(df: DataFrame, col: str) -> DataFrame:
    """Watermarks need ``TIMESTAMP``; the tables carry ``TIMESTAMP_NTZ``."""
    return df.withColumn(col, F.col(col).cast("timestamp"))


def audit_ingest(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Append audit records, dropping repeated trace ids within the watermark."""
    e = as_event_time(events, "received_at")
    return e.withWatermark("received_at", watermark) \
            .dropDuplicatesWithinWatermark(["trace_id"])


def latency_summary_stream(log: DataFrame, window: str = "1 hour",
                           watermark: str = "2 hours") -> DataFrame:
    """Windowed latency summary; a window is emitted once the watermark passes
    its end (append mode), or updated per batch (update mode)."""
    e = as_event_time(log, "received_at").withWatermark("received_at", watermark)
    return LG.audit_latency_summary(e, window)


def quota_window_stream(requests: DataFrame, identity: str, ts: str, window: str = "1 hour",
                        watermark: str = "10 minutes", limit: int = 2) -> DataFrame:
    """Requests per identity and window; windows over ``limit`` are flagged."""
    e = as_event_time(requests, ts).withWatermark(ts, watermark)
    g = e.groupBy(identity, F.window(ts, window).alias("w")).agg(
        F.count(F.lit(1)).alias("n"))
    return g.select(identity, F.col("w.start").alias("window_start"), "n",
                    (F.col("n") > limit).alias("over_limit"),
                    F.greatest(F.col("n") - F.lit(limit), F.lit(0)).alias("rejected"))


STATUS_OUT = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("since", T.TimestampType()), T.StructField("order", T.LongType()),
])
STATUS_STATE = T.StructType([
    T.StructField("status", T.StringType()), T.StructField("since", T.TimestampType()),
    T.StructField("order", T.LongType()), T.StructField("terminal", T.BooleanType()),
])


def _best(pdf: pd.DataFrame, term: set) -> pd.DataFrame:
    """Rows (key, status, ts, order) -> per key the newest row and the newest
    terminal one: all that the current status and the watermark need."""
    by = pdf.dropna(subset=["ts"]).sort_values(["ts", "order"], kind="stable")
    ends = by[by["status"].isin(term)].groupby("key", dropna=False).tail(1)
    last = by.groupby("key", dropna=False).tail(1)
    return pd.concat([last, ends[~ends.index.isin(last.index)]])


def status_stream(events: DataFrame, key: str, status: str, ts: str, order: str,
                  terminal: tuple = LG.TERMINAL_STATES, terminal_ttl: str | None = None,
                  watermark: str = "1 day") -> DataFrame:
    """Current status per key as keyed state (``applyInPandasWithState``).

    The state is one row per key; a terminal state is sticky; within and
    across micro-batches the latest (ts, order) wins otherwise.  Output mode
    ``update``: every batch emits the keys it changed.  Rows are reduced per
    key before the shuffle, so a hot key sends two rows per Arrow batch.  Rows
    without a time take no part; a null key is a key.

    With ``terminal_ttl`` (``"7 days"``) events get a ``watermark``, later ones
    are dropped, and the state of a key goes once the watermark passes its
    terminal time by the TTL; an event after that starts the key anew.
    Without it the state of every key is kept.
    """
    ship_package(events.sparkSession)
    term = set(terminal)
    zone = events.sparkSession.conf.get("spark.sql.session.timeZone")
    ttl_ms = None if terminal_ttl is None else int(pd.Timedelta(terminal_ttl).total_seconds() * 1000)

    def reduce_rows(pdfs):
        for pdf in pdfs:
            yield _best(pdf, term)

    def fn(k, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        cur = None
        if state.exists:
            s = state.get
            cur = (bool(s[3]), pd.Timestamp(s[1]), int(s[2]), s[0])
        for pdf in pdfs:
            for st, at, o in _best(pdf, term)[["status", "ts", "order"]].itertuples(index=False):  # two rows at most
                cand = (st in term, pd.Timestamp(at), int(o), st)
                if cur is None or cand[:3] > cur[:3]:
                    cur = cand
        if cur is None:
            return
        state.update((cur[3], cur[1].to_pydatetime(), cur[2], cur[0]))
        if ttl_ms is not None and cur[0]:
            here = cur[1].tz_localize(zone, ambiguous=True, nonexistent="shift_forward")
            gone = int(here.timestamp() * 1000) + ttl_ms
            if gone > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(gone)
            else:
                state.remove()
        yield pd.DataFrame({"key": [None if k[0] is None else str(k[0])], "status": [cur[3]], "since": [cur[1]],
                            "order": [cur[2]]})

    e = as_event_time(events.select(F.col(key).cast("string").alias("key"), F.col(status).alias("status"),
                                    F.col(ts).alias("ts"), F.col(order).cast("long").alias("order")), "ts")
    e = e.mapInPandas(reduce_rows, e.schema)
    if ttl_ms is None:
        return e.groupBy("key").applyInPandasWithState(fn, STATUS_OUT, STATUS_STATE, "update", "NoTimeout")
    return e.withWatermark("ts", watermark).groupBy("key").applyInPandasWithState(
        fn, STATUS_OUT, STATUS_STATE, "update", "EventTimeTimeout")


def ingest_counted(events: DataFrame, root: str, delay: str = "1 hour", trace: str = "trace_id",
                   ts: str = "received_at") -> dict[str, DataFrame]:
    """Audit ingest that accounts for every row: ``kept`` (first record of a
    trace), ``late`` (behind the batch's watermark) and ``counts`` (per batch:
    arrived = kept + repeated + late, and the watermark it ran with).

    The watermark of a batch is the largest time of the batches before it,
    minus ``delay``; a row without a time is late.  A record repeats an earlier
    one of its batch (the smallest time stays, then the smallest row) or a kept
    one whose time is at most ``delay`` behind the watermark.  Every batch
    writes folders of its own and replaces them when it is run again, so a
    restart on the same ``root`` neither loses nor repeats a row.
    """
    spark = events.sparkSession
    schema = as_event_time(events, ts).schema
    span = F.expr(f"INTERVAL {delay}")
    counts_schema = "batch long, arrived long, kept long, repeated long, late long, top timestamp, watermark timestamp"

    def read(name, wanted):
        path = f"{root}/{name}"
        spark.createDataFrame([], wanted).drop("batch").write.mode("ignore").parquet(f"{path}/batch=-1")  # there is a table
        return spark.read.schema(wanted).parquet(path).where("batch >= 0")

    kept_schema = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    plain_counts = counts_schema.split(", ", 1)[1]

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        known = read("counts", counts_schema).where(F.col("batch") < batch_id)
        mark = known.agg((F.max("top") - span).alias("w")).first()["w"]
        rows = batch.persist()
        try:
            is_late = F.col(ts).isNull()
            if mark is not None:
                is_late = is_late | (F.col(ts) < F.lit(mark))
            told = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_late, 1)).alias("late"),
                            F.max(ts).alias("top")).first()
            rows.where(is_late).write.mode("overwrite").parquet(f"{root}/late/batch={batch_id}")
            first = rows.where(~is_late).groupBy(trace).agg(
                F.min(F.struct(ts, *[c for c in rows.columns if c not in (ts, trace)])).alias("r")) \
                .select(*[F.col(trace) if c == trace else F.col(f"r.{c}").alias(c) for c in rows.columns])
            earlier = read("kept", kept_schema).where(F.col("batch") < batch_id)
            if mark is not None:
                earlier = earlier.where(F.col(ts) >= F.lit(mark) - span)
            held = earlier.select(F.col(trace).alias("_held"))
            seen = Observation()
            first.join(held, F.col(trace).eqNullSafe(F.col("_held")), "left_anti") \
                .observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{root}/kept/batch={batch_id}")
            kept = seen.get["n"]
            spark.createDataFrame([(told["n"], kept, told["n"] - told["late"] - kept, told["late"], told["top"], mark)],
                                  plain_counts).coalesce(1).write.mode("overwrite").parquet(f"{root}/counts/batch={batch_id}")
        finally:
            rows.unpersist()

    as_event_time(events, ts).writeStream.option("checkpointLocation", f"{root}/_checkpoint") \
        .trigger(availableNow=True).foreachBatch(write_batch).start().awaitTermination()
    return {"kept": read("kept", kept_schema), "late": read("late", kept_schema),
            "counts": read("counts", counts_schema)}
