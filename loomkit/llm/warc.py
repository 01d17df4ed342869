"""WARC archives as a PySpark Python data source.

Writing: one gzip member per record, with the standard's skip-length extra
field ("sl": compressed and uncompressed size of the member).  Every task rolls
its own files in the target folder and reports them; each job's commit writes a
manifest of its own, so files of failed or repeated tasks are never read and
later jobs add to a folder.  Which payloads repeat is decided on digests alone.

Reading: the driver plans file partitions by size.  A task inflates the head of
a member only as far as the blank line behind its headers, tests the pushed
predicates on record type and headers, and jumps over members that do not
match; a payload is inflated and decoded only where it is asked for.  Archives
of other writers are read as well: members without the extra field, plain
``.warc`` files, other charsets, revisits of records that are not pages here.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, IsNull,
    WriterCommitMessage,
)

from loomkit.llm.common import materialise, shared_path, spread, text_chunks

SCHEMA = ("record_type string, record_id string, page_id long, url string, refers_to long, "
          "payload_bytes long, payload_digest string, payload string, refers_to_id string")
MANIFEST = "_manifest"  # the first part of each job's manifest name
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
FILE_BYTES, PARTITION_BYTES, HEAD_BYTES = 64 << 20, 64 << 20, 4096
DATE = "1970-01-01T00:00:00Z"  # archives of the same rows are the same bytes
SALTS = 16  # tasks that share the copies of one payload
_PAGES = uuid.UUID("a0b1c2d3-0000-5000-8000-000000000001")  # fixed value: name space of record ids


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _fs(path: str):
    from pyarrow import fs
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def record_id(page_id, record_type: str = "response") -> str:
    """A page's record id: the same in every archive, so that revisits resolve."""
    return str(uuid.uuid4() if page_id is None else uuid.uuid5(_PAGES, f"{record_type}:{page_id}"))


def record(row: dict) -> bytes:
    """The bytes of one record, headers and block, with the closing blank lines."""
    block = HTTP_HEAD + (row["payload"] or "").encode("utf-8", "surrogatepass") * (row["record_type"] == "response")
    head = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<urn:uuid:{row['record_id']}>"),
            ("WARC-Date", DATE), ("Content-Type", "application/http; msgtype=response"),
            ("Content-Length", len(block)), ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"),
            ("X-Payload-Length", row["payload_bytes"])]
    if row["page_id"] is not None:
        head.append(("X-Page-ID", row["page_id"]))
    if row["url"] is not None:
        head.append(("WARC-Target-URI", "".join(f"%{ord(c):02X}" if ord(c) < 33 else c for c in row["url"])))
    if row["record_type"] == "revisit":
        head.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        head.append(("WARC-Refers-To", f"<urn:uuid:{row['refers_to_id']}>"))
        if row["refers_to"] is not None:
            head.append(("X-Refers-To-Page", row["refers_to"]))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return text.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """One gzip member with the skip-length field."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(raw) + deflate.flush()
    size = 24 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(raw) & 0xFFFFFFFF)
    return (b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body
            + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF))


@dataclass
class Files(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool = False):
        self.path, self.overwrite = options["path"], overwrite
        self.limit = int(options.get("fileBytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        done, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size >= self.limit:
                    if out is not None:
                        out.close()
                        done[-1][1] = size
                    name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    done.append([name, 0])
                data = member(record(row))
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
            done[-1][1] = size
        return Files(done)

    def commit(self, messages: list) -> None:
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        files = sorted(f for m in messages if m for f in m.files)
        before = _manifests(fs, root) if self.overwrite else []
        with fs.open_output_stream(f"{root}/{MANIFEST}-{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps(files).encode())
        for name in before:
            fs.delete_file(f"{root}/{name}")

    def abort(self, messages: list) -> None:
        fs, root = _fs(self.path)
        for m in messages:
            for name, _ in m.files if m else ():
                fs.delete_file(f"{root}/{name}")


def _manifests(fs, root: str) -> list[str]:
    from pyarrow import fs as pafs
    return [i.base_name for i in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
            if i.base_name.startswith(MANIFEST) and i.base_name.endswith(".json")]


class FilePart(InputPartition):
    def __init__(self, files: list):
        self.files = files


# header of each column, for predicates that can be tested before the payload
_HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "page_id": "x-page-id",
            "url": "warc-target-uri", "payload_bytes": "x-payload-length", "payload_digest": "warc-payload-digest",
            "refers_to": "x-refers-to-page", "refers_to_id": "warc-refers-to"}


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "decode") == "decode"
        self.part_bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.tests: list[tuple[str, set | None, bool]] = []  # column, wanted values, null wanted

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in _HEADERS:
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append((column, {f.value}, False))
            elif isinstance(f, In):
                self.tests.append((column, set(f.value), False))
            elif isinstance(f, IsNotNull):
                self.tests.append((column, None, False))
            elif isinstance(f, IsNull):
                self.tests.append((column, None, True))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs as pafs
        fs, root = _fs(self.path)
        files = []
        for name in (jobs := _manifests(fs, root)):
            with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                files += json.loads(f.read())
        if not jobs:  # archives of another writer
            files = [[i.base_name, i.size] for i in fs.get_file_info(pafs.FileSelector(root))
                     if i.base_name.endswith((".warc.gz", ".warc"))]
        parts, size = [], 0
        for name, n in sorted(files, key=lambda f: -f[1]):
            if not parts or size + n > self.part_bytes:
                parts.append([])
                size = 0
            parts[-1].append(name)
            size += n
        return [FilePart(p) for p in parts] or [FilePart([])]

    def _wanted(self, row: dict) -> bool:
        return all(row[c] is None if null else row[c] is not None and (values is None or row[c] in values)
                   for c, values, null in self.tests)

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(self.path)
        names = [x.strip().split()[0] for x in SCHEMA.split(",")]
        types = [pa.int64() if x.strip().endswith("long") else pa.string() for x in SCHEMA.split(",")]
        schema = pa.schema(list(zip(names, types)))
        rows, held = [], 0
        for name in partition.files:
            with fs.open_input_file(f"{root}/{name}") as f:
                for row in records(f, self._wanted, self.payload):
                    rows.append(row)
                    held += len(row["payload"] or "") + 200
                    if held > 4_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _columns(head: dict) -> dict:
    number = lambda x: int(x) if x is not None and re.fullmatch("-?[0-9]+", x) else None
    bare = lambda x: (x or "").removeprefix("<").removesuffix(">").removeprefix("urn:uuid:") or None
    return {"record_type": head.get("warc-type"), "record_id": bare(head.get("warc-record-id")),
            "page_id": number(head.get("x-page-id")), "url": head.get("warc-target-uri"),
            "refers_to": number(head.get("x-refers-to-page")), "refers_to_id": bare(head.get("warc-refers-to")),
            "payload_bytes": number(head.get("x-payload-length")),
            "payload_digest": (head.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
            "payload": None}


def _headers(raw: bytes) -> dict:
    lines = _text(raw, "utf-8").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def _text(raw: bytes, charset: str) -> str:
    """Bytes as text: by UTF-8 or the declared charset, else byte by byte."""
    for name in (charset, "utf-8"):
        try:
            return raw.decode(name, "surrogatepass" if name == "utf-8" else "strict")
        except (UnicodeError, LookupError):
            continue
    return raw.decode("latin-1")


def plain_records(f, at: int, wanted, payload: bool) -> Iterator[dict]:
    """Records of an uncompressed archive; blocks that are not wanted are skipped."""
    end = f.size()
    while at < end:
        f.seek(at)
        raw = b""
        while b"\r\n\r\n" not in raw and (more := f.read(HEAD_BYTES)):
            raw += more
        if not raw.strip():
            return
        skip = len(raw) - len(raw.lstrip(b"\r\n"))
        head = raw[skip:].partition(b"\r\n\r\n")[0]
        fields = _headers(head)
        start, size = at + skip + len(head) + 4, int(fields.get("content-length", 0))
        row = _columns(fields)
        if wanted(row):
            if payload and row["record_type"] == "response":
                f.seek(start)
                row = _with_payload(row, fields, f.read(size))
            yield row
        at = start + size


def records(f, wanted, payload: bool) -> Iterator[dict]:
    """Records of one archive whose header columns pass ``wanted``; the payload
    of a response is decoded, and held against its digest, if ``payload``."""
    at, end = 0, f.size()
    while at < end:
        f.seek(at)
        data = f.read(HEAD_BYTES)
        flags = data[3]
        if data.lstrip(b"\r\n")[:5] == b"WARC/":
            yield from plain_records(f, at, wanted, payload)
            return
        if data[:3] != b"\x1f\x8b\x08":
            raise ValueError("not a gzip member")
        start, size = 10, None
        if flags & 4:
            n = struct.unpack_from("<H", data, 10)[0]
            if data[12:14] == b"sl" and n >= 12:
                size = struct.unpack_from("<I", data, 16)[0]
            start = 12 + n
        if flags & ~4 or size is None:  # another writer's member: its end is known after inflating it
            inflate = zlib.decompressobj(31)
            raw, used = bytearray(), 0
            f.seek(at)
            while not inflate.eof and (chunk := f.read(1 << 16)):
                used += len(chunk)
                raw += inflate.decompress(chunk)
            at += used - len(inflate.unused_data)
            head, _, rest = bytes(raw).partition(b"\r\n\r\n")
            row = _columns(_headers(head))
            if wanted(row):
                yield _with_payload(row, _headers(head), rest) if payload else row
            continue
        inflate = zlib.decompressobj(-15)
        raw = inflate.decompress(data[start:], HEAD_BYTES)
        taken = len(data)
        while b"\r\n\r\n" not in raw and not inflate.eof:
            more = inflate.unconsumed_tail or f.read(HEAD_BYTES)
            taken += 0 if inflate.unconsumed_tail else len(more)
            raw += inflate.decompress(more, HEAD_BYTES)
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = _headers(head)
        row = _columns(fields)
        if wanted(row):
            if payload and row["record_type"] == "response":
                rest += inflate.decompress(inflate.unconsumed_tail)
                if size > taken:
                    f.seek(at + taken)
                    rest += inflate.decompress(f.read(size - taken))
                row = _with_payload(row, fields, rest)
            yield row
        at += size


def _with_payload(row: dict, head: dict, rest: bytes) -> dict:
    if row["record_type"] != "response":
        return row
    block = rest[:int(head["content-length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    if "x-payload-length" in head and payload_digest(body) != row["payload_digest"]:
        raise ValueError(f"record {row['record_id']}: the payload does not have its digest")
    said = re.search(rb"(?i)content-type:[^\r\n]*charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", http)
    size = row["payload_bytes"] if row["payload_bytes"] is not None else len(body)
    return row | {"payload": _text(body, said[1].decode().lower() if said else "utf-8"), "payload_bytes": size}


class WarcSource(DataSource):
    """``spark.read.format("warc").option("payload", "decode" | "skip").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def enable(spark: SparkSession) -> None:
    """Register the source, and let predicates reach it."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in text_chunks(batches, "payload"):
        first = [None if pd.isna(x) else int(x) for x in pdf["refers_to"]]
        ids = [None if pd.isna(x) else int(x) for x in pdf["page_id"]]
        yield pd.DataFrame({
            "record_type": pdf["record_type"], "record_id": list(map(record_id, ids, pdf["record_type"])),
            "page_id": pd.array(ids, "Int64"), "url": pdf["url"], "refers_to": pd.array(first, "Int64"),
            "payload_bytes": pdf["payload_bytes"],
            "payload_digest": [base64.b32encode(bytes.fromhex(x)).decode() for x in pdf["sha"]],
            "payload": pdf["payload"], "refers_to_id": [None if x is None else record_id(x) for x in first]})


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
               html_col: str = "html", min_revisit_bytes: int = 0) -> None:
    """Archive every row of ``pages``: of equal payloads of at least
    ``min_revisit_bytes`` the largest id is the response, the others revisit it.

    A null html is an empty payload.  Rows with a null id are responses unless
    their payload has a row with an id; rows that repeat the largest id are all
    responses, under the one record id of that page.  A null url gives no target address; white space in one is
    percent-encoded.  An empty table gives an archive without records.
    """
    spark = pages.sparkSession
    enable(spark)
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    src = spread(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                              html.alias("html"))) \
        .select("*", F.octet_length("html").cast("long").alias("payload_bytes"),
                F.sha1(F.col("html").cast("binary")).alias("sha"))
    # payloads that repeat, by digest; written first, so that a small table is broadcast by its size
    first = materialise(
        src.where(F.col("payload_bytes") >= min_revisit_bytes).groupBy("sha")
        .agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
        .select("first", "sha", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")), "repeated")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = src.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")) \
        .join(first, ["sha", "salt"], "left").select(
            F.when(revisit, "revisit").otherwise("response").alias("record_type"), "page_id", "url",
            F.when(revisit, F.col("first")).alias("refers_to"), "payload_bytes", "sha",
            F.when(~revisit, F.col("html")).alias("payload"))
    rows.mapInPandas(_rows, SCHEMA).write.format("warc").mode("append").option("path", path).save()


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of the archives in ``path``; filters on header columns are
    tested before any payload, and without ``payload`` none is decoded."""
    enable(spark)
    return spark.read.format("warc").option("payload", "decode" if payload else "skip").load(path)


def archive_round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Write ``pages`` into a fresh archive in the shared folder and read it
    back, responses with their payloads and revisits by their headers."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_warc(pages, path, **columns)
    full = read_warc(spark, path).where("record_type = 'response'") \
        .withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    light = read_warc(spark, path, payload=False).where("record_type = 'revisit'")
    return full.unionByName(light).select("page_id", "payload_bytes", "payload_digest", "record_type",
                                          "refers_to", "url", "payload")
