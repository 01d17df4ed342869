"""Sources, sinks and streams: fingerprints equal hashlib, a stream restarted
on its checkpoint only processes new files, update-mode sinks keep the newest
row per key."""

import gzip
import hashlib
import os
import random
import tempfile

from pyspark.sql import functions as F

from loomkit.session import load_table
from loomkit.sources import digest
from loomkit.sources import files as SRC
from loomkit.streaming.audit import file_stream
from tests.conftest import SMALL


def with_conf(spark, key, value):
    if value is None:
        spark.conf.unset(key)
    else:
        spark.conf.set(key, value)


def test_file_fingerprint_matches_hashlib(spark):
    got = {r["name"]: (r["size_bytes"], r["sha256"])
           for r in SRC.file_fingerprint(spark, f"{SMALL}/*.parquet").collect()}
    for name, (size, digest) in got.items():
        data = open(os.path.join(SMALL, name), "rb").read()
        assert size == len(data) and digest == hashlib.sha256(data).hexdigest()


def test_fingerprint_size_cap_skips_content(spark):
    rows = SRC.file_fingerprint(spark, f"{SMALL}/*.parquet", max_bytes=5000).collect()
    assert any(r["too_large"] and r["sha256"] is None for r in rows)
    assert any(not r["too_large"] for r in rows)


def test_large_files_are_hashed_in_bounded_pieces(spark, monkeypatch, tmp_path):
    rng = random.Random(3)
    noise = rng.randbytes(700_000)
    bom, one_line = b"\xef\xbb\xbf", b"[" + b"12345, " * 60_000 + b"6]"
    long = noise.replace(b"\n", b"").replace(b",", b"")
    edge = b"x" * 65_535 + b"\n" + b"y" * 65_536 + b"z" * 40_000 + b"\n" + noise  # a long line starts with a split
    contents = {
        "noise.parquet": noise, "ends.csv": b"a,b\r\n" * 40_000, "open.csv": b"a,b\n" * 40_000 + b"c",
        "empty lines.csv": b"\n" * 150_000, "bom%20é.csv": bom + b"a\n\xff\n" * 50_000, "bom_open.csv": bom + noise + b"x",
        "one_line.json": one_line, "long.csv": long, "edge.csv": edge, "small.csv": b"a\n",
        "packed.csv.gz": gzip.compress(noise), "exact.csv": noise[:131_072], "capped.csv": noise + noise}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    monkeypatch.setattr(digest, "PIECE", 131_072)
    monkeypatch.setattr(digest, "LINE", 65_536)
    given, of_pieces = [], digest.sha256_by_pieces
    monkeypatch.setattr(digest, "sha256_by_pieces", lambda *a: given.append(of_pieces(*a)) or given[-1])
    for split in ("64k", "50000b", "1m"):
        with_conf(spark, "spark.sql.files.maxPartitionBytes", split)
        try:
            got = {r["name"]: r for r in SRC.file_fingerprint(spark, f"{tmp_path}/*", max_bytes=1_000_000).collect()}
        finally:
            with_conf(spark, "spark.sql.files.maxPartitionBytes", None)
        assert set(got) == set(contents)
        for name, data in contents.items():
            large = len(data) > 1_000_000
            assert got[name]["size_bytes"] == len(data) and got[name]["too_large"] == large, name
            assert got[name]["sha256"] == (None if large else hashlib.sha256(data).hexdigest()), name
        names = {p.rsplit("/", 1)[-1] for p in given[-1]}
        assert {"noise.parquet", "ends.csv", "open.csv", "bom_open.csv", "one_line.json"} <= names
        assert not {"long.csv", "packed.csv.gz", "exact.csv", "capped.csv", "small.csv"} & names

    with_conf(spark, "spark.sql.files.maxPartitionBytes", "64k")
    files = {p: len(noise) for p in given[-1] if p.endswith("noise.parquet")}
    chunks = digest._written_chunks(spark, str(tmp_path), sorted(files), "\n")
    with_conf(spark, "spark.sql.files.maxPartitionBytes", None)
    read = chunks.groupBy("piece").agg(F.sum("n").alias("n")).collect()
    assert len(read) == 6 and max(r["n"] for r in read) < 131_072 + 2 * 65_536


def test_load_dataset_rejects_unknown_suffix(spark):
    import pytest
    with pytest.raises(ValueError):
        SRC.load_dataset(spark, "/nowhere/data.xlsx")
    with pytest.raises(ValueError):
        SRC.load_dataset(spark, "/nowhere/data.txt")  # only the batch scorer reads .txt


def test_stream_resumes_from_checkpoint(spark):
    ev = load_table(spark, SMALL, "events")
    root = tempfile.mkdtemp(prefix="loomkit-stream-")
    inbox, sink, ckpt = f"{root}/inbox", f"{root}/sink", f"{root}/ckpt"
    first = ev.where(F.col("event_id") % 2 == 0)
    second = ev.where(F.col("event_id") % 2 == 1)
    first.write.parquet(f"{inbox}/a")

    def run():
        s = file_stream(spark, inbox, ev.schema, options={"recursiveFileLookup": "true"})
        q = s.writeStream.format("parquet").option("checkpointLocation", ckpt) \
             .trigger(availableNow=True).start(sink)
        q.awaitTermination()

    run()
    assert spark.read.parquet(sink).count() == first.count()
    second.write.parquet(f"{inbox}/b")
    run()  # a restart processes only the new files: no duplicates, nothing lost
    out = spark.read.parquet(sink)
    assert out.count() == ev.count()
    assert out.select("event_id").distinct().count() == ev.count()
