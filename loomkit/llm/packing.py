"""Concatenate and cut: token streams into fixed windows, without a global sort.

Pass 1 encodes every document in the scan's own partitions, numbers its ids
from the start of the partition and writes that table to the shared folder;
what a partition holds, and in which order, is thereby fixed.  The partition
totals (one row per partition) give global offsets by a prefix sum.  Pass 2
reads the table, adds the offset and cuts at every multiple of the window; a
document that crosses a cut leaves boundary pieces on both sides.  Only the
last window is not full, so padding is below one window for the whole corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomkit.llm.common import materialise, spread, text_chunks
from loomkit.llm.tokens import vocabulary_path, word_bpe

WINDOW, END_ID = 2048, 1


def _encoded(path: str, end_id: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, part, before = word_bpe(path), TaskContext.get().partitionId(), 0
        for pdf in text_chunks(batches):
            ids = coder.encode([t or "" for t in pdf["text"]])
            size = np.array([len(x) + 1 for x in ids], np.int64)
            start = before + np.cumsum(size) - size
            before = int(start[-1] + size[-1]) if len(size) else before
            yield pd.DataFrame({
                "doc": pdf["doc"], "part": part, "local": start, "n": size,
                "ids": [np.append(x, end_id).astype("<u2" if x.max(initial=end_id) < 65536 else "<u4").tobytes()
                        for x in ids]})
    return run


def _cut(window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, n, raw, at in zip(pdf["doc"], pdf["n"], pdf["ids"], pdf["at"]):
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                start = 0
                while start < n:
                    seq, offset = divmod(at + start, window)
                    length = min(window - offset, n - start)
                    piece = ids[start:start + length].tobytes()
                    rows.append((doc, start, length, zlib.crc32(piece), n, seq, offset, piece))
                    start += length
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens",
                                              "sequence_id", "offset", "ids"])
    return run


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                     end_id: int = END_ID) -> DataFrame:
    """``(doc, part, local, n, ids)``: ids of every document with ``end_id``
    behind, little-endian, and their place in the partition; written once."""
    src = spread(docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")))
    return materialise(src.mapInPandas(
        _encoded(path, end_id), "doc long, part int, local long, n long, ids binary"), "tokens")


def pack_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id",
                   text_col: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, ids`` (little-endian unsigned 32-bit ids).

    Every id of every document, ``end_id`` included, lies in exactly one piece;
    sequences are numbered from 0 and all but the last are full.  A null or
    empty text is the single id ``end_id``; repeated rows are packed each by
    itself, a null id stays null, an empty table gives no rows, other columns
    of ``docs`` are ignored.
    """
    tokens = encode_documents(docs, path or vocabulary_path("word_bpe_49k.json"), id_col, text_col, end_id)
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    # one row per partition of pass 1: small enough for one task and a broadcast
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    placed = tokens.join(F.broadcast(before), "part").select(
        "doc", "n", "ids", (F.col("base") + F.col("local")).alias("at"))
    return placed.mapInPandas(
        _cut(window), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                      "sequence_id long, offset long, ids binary")


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """``(sequence_id, ids, n_tokens)``: the windows themselves.  Each is padded
    with ``pad_id`` to ``window`` ids, except where its length is a power of two."""
    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = b"".join(pdf.sort_values("offset")["ids"])
        ids = np.frombuffer(raw, "<u4").astype(np.int64)
        n = len(ids)
        if n & (n - 1):
            ids = np.append(ids, np.full(window - n, pad_id))
        return pd.DataFrame({"sequence_id": [pdf["sequence_id"].iloc[0]], "ids": [ids], "n_tokens": [n]})
    return pieces.groupBy("sequence_id").applyInPandas(
        join, "sequence_id long, ids array<long>, n_tokens long")
