import base64
import gzip
import hashlib

from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In

from loomkit.llm.common import shared_path
from loomkit.llm.warc import WarcReader, archive_round_trip, read_warc, write_warc

SCHEMA = "page_id long, url string, html string"
ODD = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\né " + "y" * 9000
ROWS = [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (5, None, "<p>one</p>"), (3, "http://a b\n3", ODD),
        (4, "http://a/4", None), (6, "http://a/6", ""), (7, "http://a/7", "big " * 100_000), (8, "x", "\U0001f600")]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns(
        {c: F.lit("clash") for c in ("payload", "packed", "first", "record_type", "n")})


def brute(rows, least=0):
    out = {}
    for i, _, h in rows:
        raw = (h or "").encode()
        top = max(j for j, _, g in rows if (g or "") == (h or ""))
        same = len(raw) >= least and top != i
        out[i] = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(),
                  "revisit" if same else "response", top if same else None)
    return out


def test_round_trip_equals_brute_force(spark):
    got = {r.page_id: r for r in archive_round_trip(frame(spark, ROWS)).collect()}
    assert {i: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for i, r in got.items()} == brute(ROWS)
    assert all(got[i].payload == (h or "") for i, _, h in ROWS if got[i].record_type == "response")
    assert got[5].url is None and got[1].payload is None
    small = {r.page_id: r.record_type for r in archive_round_trip(frame(spark, ROWS), min_revisit_bytes=5).collect()}
    assert small == {i: w[2] for i, w in brute(ROWS, 5).items()} and small[4] == "response"


def test_archives_are_standard_gzip(spark):
    path = shared_path(spark, "warc-test").removeprefix("file:")
    write_warc(frame(spark, ROWS), path)
    import pathlib
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in pathlib.Path(path).glob("*.warc.gz"))
    assert raw.count(b"WARC/1.1\r\nWARC-Type: ") >= len(ROWS) and ODD.encode() in raw


def test_predicates_are_pushed_and_payloads_skipped(spark):
    path = shared_path(spark, "warc-test")
    write_warc(frame(spark, ROWS), path)
    light = read_warc(spark, path, payload=False)
    assert light.where("payload is not null").count() == 0 and light.count() == len(ROWS)
    some = light.where("record_type = 'revisit' and page_id in (1, 4)")
    assert sorted(r.page_id for r in some.collect()) == [1, 4]
    reader = WarcReader({"path": path, "payload": "skip"})
    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), In(("page_id",), (1, 4)),
                                    EqualTo(("payload",), "x")]))
    assert [f.attribute for f in left] == [("payload",)]  # the others are tested on the headers
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(r["page_id"] for r in rows) == [1, 4]
    assert read_warc(spark, path).where("url is null").count() == 1
    assert read_warc(spark, path).where("page_id > 6").count() == 2


def test_members_of_other_writers_are_read(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\n\r\nhello"
    for name, text in (("a", block), ("b", block * 1000)):
        raw = b"WARC/1.0\r\nWARC-Type: response\r\nX-Page-ID: 3\r\nContent-Length: %d\r\n\r\n" % len(text) + text + b"\r\n\r\n"
        (tmp_path / f"{name}.warc.gz").write_bytes(gzip.compress(raw) * 3)
    assert read_warc(spark, str(tmp_path)).count() == 6
    assert len(WarcReader({"path": str(tmp_path), "partitionBytes": "1"}).partitions()) == 2


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(1, "u", "x"), (1, "u", "x"), (None, "u", "x"), (None, "u", "alone"), (None, "u", "alone")]
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in archive_round_trip(frame(spark, rows)).collect()), key=repr)
    assert got == sorted([(1, "response", None)] * 2 + [(None, "revisit", 1)] + [(None, "response", None)] * 2, key=repr)
    assert archive_round_trip(frame(spark, [])).count() == 0


def test_a_second_write_adds_and_an_overwrite_replaces(spark):
    path = shared_path(spark, "warc-test")
    write_warc(frame(spark, ROWS[:2]), path)
    write_warc(frame(spark, ROWS[4:7]), path)
    assert sorted(r.page_id for r in read_warc(spark, path).collect()) == [1, 2, 4, 6, 7]
    read_warc(spark, path).where("page_id = 2").write.format("warc").mode("overwrite").option("path", path).save()
    assert [r.page_id for r in read_warc(spark, path).collect()] == [2]


def test_revisits_name_the_record_they_repeat(spark):
    path = shared_path(spark, "warc-test")
    write_warc(frame(spark, ROWS), path)
    rows = read_warc(spark, path, payload=False).collect()
    by_id = {r.record_id: r for r in rows}
    assert len(by_id) == len(rows)
    back = [r for r in rows if r.record_type == "revisit"]
    assert back and all(by_id[r.refers_to_id].page_id == r.refers_to for r in back)


def test_foreign_archives(spark, tmp_path):
    page = "<p>déjà vu</p>".encode("latin-1")

    def told(kind, body, *more):
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\n\r\n" + body
        head = b"".join(x + b"\r\n" for x in (b"WARC-Type: " + kind, b"Content-Length: %d" % len(block), *more))
        return b"WARC/1.0\r\n" + head + b"\r\n" + block + b"\r\n\r\n"
    some = [told(b"response", page, b"WARC-Record-ID: <urn:uuid:11>", b"WARC-Payload-Digest: sha1:OTHER"),
            told(b"revisit", b"", b"WARC-Record-ID: <urn:uuid:12>", b"WARC-Refers-To: <urn:uuid:11>"),
            told(b"response", page * 2000, b"X-Page-ID: none")]
    (tmp_path / "plain.warc").write_bytes(b"".join(some))
    (tmp_path / "packed.warc.gz").write_bytes(b"".join(map(gzip.compress, some)))
    rows = read_warc(spark, str(tmp_path)).collect()
    assert len(rows) == 6 and all(r.refers_to is None and r.page_id is None for r in rows)
    assert sum(r.payload == "<p>déjà vu</p>" and r.payload_bytes == len(page) for r in rows) == 2
    assert [r.refers_to_id for r in rows if r.record_type == "revisit"] == ["11"] * 2
    light = read_warc(spark, str(tmp_path), payload=False).where("record_type = 'revisit'")
    assert light.count() == 2
