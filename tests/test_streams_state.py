"""Streams over several micro-batches: status state with a TTL, restarts on one
checkpoint, and an audit ingest that accounts for late and repeated rows."""

import datetime as dt
import tempfile

from pyspark.sql import functions as F

from loomkit.streaming.audit import file_stream, ingest_counted, run_available, status_stream


def _at(hours):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)


def _deliver(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


STATUS = "k string, status string, at timestamp, o long"


def test_status_over_batches_restarts_and_ttl(spark):
    root = tempfile.mkdtemp(prefix="loomkit-status-")

    def run(rows):
        _deliver(spark, rows, STATUS, f"{root}/inbox")
        schema = spark.createDataFrame([], STATUS).schema
        s = status_stream(file_stream(spark, f"{root}/inbox", schema), "k", "status", "at", "o",
                          terminal_ttl="2 hours", watermark="1 hour")
        out = run_available(s, "status", mode="update", keys=["key"], root=f"{root}/out")
        return {r["key"]: r["status"] for r in out.collect()}

    hot = [("hot", "running", _at(i / 5000), i) for i in range(5000)]
    assert run([("a", "queued", _at(0), 1), ("a", "running", _at(0.5), 2), ("b", "failed", _at(0.2), 3),
                (None, "queued", _at(0), 4), ("x", "running", None, 5), *hot]) == \
        {"a": "running", "b": "failed", None: "queued", "hot": "running"}
    # terminal is sticky across a restart; an order breaks equal times
    got = run([("b", "running", _at(0.9), 6), ("a", "succeeded", _at(1), 7), ("a", "running", _at(1), 8)])
    assert (got["a"], got["b"]) == ("succeeded", "failed")
    run([("c", "queued", _at(10), 9)])  # the watermark comes to 9 h: the states of a and b go
    got = run([("a", "queued", _at(11), 10), ("b", "running", _at(11), 11), ("hot", "queued", _at(0.5), 12)])
    assert (got["a"], got["b"], got["hot"]) == ("queued", "running", "running")


LOG = "trace_id string, received_at timestamp, note string"


def _expected(batches, delay):
    """The rule of ``ingest_counted`` row by row."""
    top, kept, late, counts = None, [], [], []
    for rows in batches:
        mark = None if top is None else top - delay
        held = {t for t, at, _ in kept if mark is None or at >= mark - delay}
        new, n_late = {}, 0
        for t, at, note in rows:
            if at is None or (mark is not None and at < mark):
                late.append((t, at, note))
                n_late += 1
            elif t not in new or (at, note) < new[t][1:]:
                new[t] = (t, at, note)
        fresh = [r for r in new.values() if r[0] not in held]
        kept += fresh
        counts.append((len(rows), len(fresh), len(rows) - n_late - len(fresh), n_late))
        top = max([at for _, at, _ in rows if at is not None] + ([top] if top else []), default=None)
    return kept, late, counts


def test_ingest_accounts_for_every_row(spark):
    batches = [
        [("a", _at(0), "1"), ("a", _at(0), "0"), ("b", _at(5), "2"), (None, _at(5), "3"), ("n", None, "4")]
        + [("hot", _at(4), str(i)) for i in range(300)],
        [("b", _at(5.5), "5"), ("c", _at(1), "6"), ("hot", _at(4.2), "7"), (None, _at(6), "8"), ("d", _at(6), "9")],
        [("a", _at(5.5), "10"), ("d", _at(6.5), "11"), ("e", _at(5.2), "12"), ("e", _at(4.9), "13")],
    ]
    root = tempfile.mkdtemp(prefix="loomkit-late-")
    schema = spark.createDataFrame([], LOG).schema
    for rows in batches:  # a restart on the same folder for each delivery
        _deliver(spark, rows, LOG, f"{root}/inbox")
        out = ingest_counted(file_stream(spark, f"{root}/inbox", schema), f"{root}/log", "1 hour")
    kept, late, counts = _expected(batches, dt.timedelta(hours=1))
    order = lambda rows: sorted(rows, key=str)
    cols = ["trace_id", "received_at", "note"]
    assert order(tuple(r) for r in out["kept"].select(*cols).collect()) == order(kept)
    assert order(tuple(r) for r in out["late"].select(*cols).collect()) == order(late)
    told = [tuple(r) for r in out["counts"].orderBy("batch").select("arrived", "kept", "repeated", "late").collect()]
    assert told == counts and sum(c[3] for c in counts) > 2
    assert out["counts"].where(F.col("arrived") != F.col("kept") + F.col("repeated") + F.col("late")).count() == 0
    again = ingest_counted(file_stream(spark, f"{root}/inbox", schema), f"{root}/log", "1 hour")
    assert again["kept"].count() == len(kept)  # nothing new: nothing happens
