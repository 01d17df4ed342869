"""SHA-256 of large files in pieces, so that no task reads a whole file.

SHA-256 goes through a file in order, but its state after any byte is 112
bytes, so a task may go on where another ended.  Spark's text reader splits
the files; lines of a block, joined by their separator again, are its bytes.
They are written once, by pieces, to the shared folder.  Then one job a piece
carries every file's state on by ``PIECE`` bytes, all files beside each other.

The bytes of a file must add up to its length, with no line of ``LINE`` bytes,
which the reader leaves out or cuts.  Otherwise the next of ``SEPARATORS`` is
tried; if none will do, no digest is returned and the caller reads that file
whole.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkit.session import checkpoint_dir, ship_package

PIECE = 128 * 1024 ** 2  # bytes of a file that one task hashes
LINE = 64 * 1024 ** 2  # a task holds no longer line
SEPARATORS = "\n", ","  # the second for JSON in one line
CHUNK = 1024 ** 2  # bytes in a row of the shared folder
BOM = b"\xef\xbb\xbf"  # the text reader leaves it out at the start of a file

_CHUNKS = "file int, piece int, start long, at int, data binary, n long, cut boolean"
_STATES = "file int, state binary, left long"


class _Context(ctypes.Structure):
    """OpenSSL's ``SHA256_CTX``."""
    _fields_ = [("h", ctypes.c_uint32 * 8), ("bits", ctypes.c_uint32 * 2), ("data", ctypes.c_uint32 * 16),
                ("num", ctypes.c_uint), ("md_len", ctypes.c_uint)]


@functools.cache
def _openssl():
    import _hashlib  # linked with OpenSSL, whose functions are found through it
    lib = ctypes.CDLL(_hashlib.__file__)
    lib.SHA256_Init.argtypes = [ctypes.POINTER(_Context)]
    lib.SHA256_Update.argtypes = [ctypes.POINTER(_Context), ctypes.c_char_p, ctypes.c_size_t]
    lib.SHA256_Final.argtypes = [ctypes.c_char_p, ctypes.POINTER(_Context)]
    return lib


class Sha256:
    """SHA-256 that goes on from the ``state`` of another (empty: from the start)."""

    def __init__(self, state: bytes = b""):
        self._context = _Context.from_buffer_copy(state) if state else _Context()
        if not state:
            _openssl().SHA256_Init(self._context)

    def update(self, data: bytes) -> None:
        _openssl().SHA256_Update(self._context, data, len(data))

    def state(self) -> bytes:
        return bytes(self._context)

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(32)
        _openssl().SHA256_Final(out, _Context.from_buffer_copy(self.state()))
        return out.raw.hex()


@functools.cache
def resumable() -> bool:
    """Whether OpenSSL's functions are there and a state carried on gives hashlib's digest."""
    data = bytes(range(200))
    try:
        first = Sha256()
        first.update(data[:77])
        second = Sha256(first.state())
        second.update(data[77:])
        return second.hexdigest() == hashlib.sha256(data).hexdigest()
    except (ImportError, OSError, AttributeError):
        return False


def _chunks(batches: Iterator[pa.RecordBatch], paths: list[str], sep: bytes, piece: int,
            longest: int) -> Iterator[pa.RecordBatch]:
    at, known = 0, pa.array(paths)
    for batch in batches:
        file = pc.index_in(batch.column("path"), value_set=known).to_numpy(zero_copy_only=False)
        start, lines = batch.column("start").to_numpy(zero_copy_only=False), batch.column("line")
        cuts = np.flatnonzero((np.diff(file) != 0) | (np.diff(start) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(file)], strict=True):
            if a == b:
                continue
            run = lines.slice(a, b - a)
            cut = pc.max(pc.binary_length(run)).as_py() >= longest
            data = sep.join([*run.to_pylist(), b""])
            parts = [data[i:i + CHUNK] for i in range(0, len(data), CHUNK)]
            k = len(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(file[a])] * k, pa.int32()), pa.array([int(start[a]) // piece] * k, pa.int32()),
                 pa.array([int(start[a])] * k, pa.int64()), pa.array(range(at, at + k), pa.int32()),
                 pa.array(parts, pa.binary()), pa.array([len(p) for p in parts], pa.int64()),
                 pa.array([cut] * k, pa.bool_())],
                names=["file", "piece", "start", "at", "data", "n", "cut"])
            at += k


def _carry(batches: Iterator[pa.RecordBatch], before: dict[int, tuple[bytes, int]]) -> Iterator[pa.RecordBatch]:
    now: dict[int, tuple[Sha256, int]] = {}
    for batch in batches:
        for file, data in zip(batch.column("file").to_pylist(), batch.column("data"), strict=True):
            if file not in now:
                state, left = before[file]
                now[file] = Sha256(state), left
            h, left = now[file]
            data = data.as_py()[:left]
            h.update(data)
            now[file] = h, left - len(data)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(now), pa.int32()), pa.array([h.state() for h, _ in now.values()], pa.binary()),
         pa.array([left for _, left in now.values()], pa.int64())], names=["file", "state", "left"])


def _written_chunks(spark: SparkSession, root: str, paths: list[str], sep: str) -> DataFrame:
    piece, longest = PIECE, LINE
    lines = spark.read.option("recursiveFileLookup", True).option("lineSep", sep) \
        .option("mapreduce.input.linerecordreader.line.maxlength", longest).text(root) \
        .where(F.col("_metadata.file_path").isin(paths)) \
        .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
                F.col("value").cast("binary").alias("line"))
    out = os.path.join(checkpoint_dir(spark), f"loomkit-{uuid.uuid4().hex}")
    lines.mapInArrow(lambda batches: _chunks(batches, paths, sep.encode(), piece, longest), _CHUNKS) \
        .write.partitionBy("piece").option("parquet.enable.dictionary", False).parquet(out)
    return spark.read.schema(_CHUNKS).parquet(out)


def _digests(spark: SparkSession, root: str, sizes: dict[str, int], sep: str) -> dict[str, str]:
    paths = sorted(sizes)
    chunks = _written_chunks(spark, root, paths, sep)
    read = {r["file"]: r["n"] for r in chunks.groupBy("file").agg(F.sum("n").alias("n"), F.max("cut").alias("cut"))
            .where(~F.col("cut")).collect()}
    states: dict[int, tuple[bytes, int]] = {}
    for file, n in read.items():
        size, h = sizes[paths[file]], Sha256()
        if n in (size, size + 1):  # 1 more: the last line has no separator of its own
            states[file] = h.state(), size
        elif n in (size - len(BOM), size - len(BOM) + 1):
            h.update(BOM)
            states[file] = h.state(), size - len(BOM)
    exact = sorted(states)
    for k in range(1 + max((sizes[paths[f]] - 1) // PIECE for f in exact) if exact else 0):
        done = chunks.where((F.col("piece") == k) & F.col("file").isin(exact)) \
            .repartitionById(len(paths), F.col("file")).sortWithinPartitions("file", "start", "at") \
            .select("file", "data").mapInArrow(lambda batches, s=states: _carry(batches, s), _STATES).collect()
        states.update({r["file"]: (bytes(r["state"]), r["left"]) for r in done})
    return {paths[f]: Sha256(state).hexdigest() for f, (state, left) in states.items() if left == 0}


def sha256_by_pieces(spark: SparkSession, root: str, sizes: dict[str, int]) -> dict[str, str]:
    """Digests of the files below ``root`` named in ``sizes`` (``_metadata.file_path`` -> length).

    A file whose bytes the text reader did not give in full is left out."""
    ship_package(spark)
    found: dict[str, str] = {}
    for sep in SEPARATORS:
        rest = {path: size for path, size in sizes.items() if path not in found}
        if rest:
            found.update(_digests(spark, root, rest, sep))
    return found
