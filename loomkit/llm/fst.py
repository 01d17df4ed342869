"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from a model file: the normaliser (blanks to the
white-space mark, the mark before the text, the model's own character map where
it has one), the pieces (a trie whose accepting states emit an id), and byte
fallback (an arc for a character that is no piece, emitting its bytes).  Their
composition with an input is a lattice over its positions; the encoding is its
shortest path in the tropical semiring.

Weights: a unigram piece costs its negative score.  In a merge (BPE) model a
sequence is the encoding exactly if every two neighbours are the encoding of
their own concatenation, for merges never depend on what lies further away.
An arc thus costs nothing behind a neighbour it is compatible with and infinity
behind any other, and one path alone has a finite cost.  Arcs are tried longest
first and dead states are not entered twice, so the search reads little more
than the path itself.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomkit.llm.common import spread, text_chunks
from loomkit.llm.tokens import WordTable, _cut, flatten, vocabulary_path

MARK = "▁"
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
MAX_PAIRS = 1_000_000  # remembered pair costs per worker
UNIGRAM, BPE = 1, 2


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """``(field number, value)`` of one protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        x = shift = 0
        while True:
            b = raw[at]
            at += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = varint() if key & 7 == 2 else 8 if key & 7 == 1 else 4
            yield key >> 3, raw[at:at + n]
            at += n


class Transducer:
    """A compiled model: ``encode`` texts to ids and ``decode`` them back."""

    def __init__(self, path: str):
        import sentencepiece
        self.path = path
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = {2: {}, 3: {}}
        for number, value in _fields(sp.serialized_model_proto()):
            if number in spec:
                spec[number] = dict(_fields(value))
        self.kind = spec[2].get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are transducers of pieces")
        norm = spec[3]
        self.char_map = bool(norm.get(2))
        self.prefix, self.trim, self.escape = (bool(norm.get(k, 1)) for k in (3, 4, 5))
        n = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes_id, self.byte_of = {}, {}
        for i, piece in enumerate(self.pieces):
            if sp.is_byte(i):
                self.bytes_id[int(piece[3:5], 16)] = i
                self.byte_of[i] = int(piece[3:5], 16)
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece], self.score[piece] = i, sp.get_score(i)
        self.unk = sp.unk_id()
        self.quiet = {i for i in range(n) if sp.is_control(i)}
        self.unknown_cost = 10.0 - min(self.score.values(), default=0.0)
        self.trie: dict = {}
        for piece in self.ids:
            at = self.trie
            for ch in piece:
                at = at.setdefault(ch, {})
            at[""] = piece
        # pieces with a mark behind another character would forbid cutting there
        self.cuttable = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.pair_cost: dict[tuple[str, str], bool] = {}
        self.table = WordTable(lambda chunks: flatten([self._ids(self.shortest(c)) for c in chunks]))

    # the three machines -----------------------------------------------------

    @functools.cached_property
    def _mapper(self):
        import sentencepiece
        return sentencepiece.SentencePieceNormalizer(model_file=self.path)

    def normalise(self, text: str) -> str:
        if self.char_map:
            return self._mapper.normalize(text)
        if self.trim:
            text = re.sub(" {2,}", " ", text.strip(" "))
        if not text:
            return ""
        text = " " * self.prefix + text
        return text.replace(" ", MARK) if self.escape else text

    def arcs(self, s: str, at: int) -> list[str]:
        """Labels of the arcs that leave a position, longest first; a character
        that is no piece has its fallback arc."""
        node, out = self.trie, []
        for i in range(at, len(s)):
            node = node.get(s[i])
            if node is None:
                break
            if "" in node:
                out.append(node[""])
        if s[at] not in self.ids:
            out.insert(0, s[at])
        out.reverse()
        return out

    def _ids(self, path: list[str]) -> list[int]:
        out: list[int] = []
        for piece in path:
            if piece in self.ids:
                out.append(self.ids[piece])
            elif self.bytes_id:
                out += [self.bytes_id[b] for b in piece.encode("utf-8", "replace")]
            elif not out or out[-1] != self.unk:
                out.append(self.unk)
        return out

    # weights ------------------------------------------------------------------

    def merged(self, s: str) -> list[str]:
        """Pieces of a short string by its merges, best score first, then leftmost."""
        parts = list(s)
        while len(parts) > 1:
            best, where = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, where = score, i
            if best is None:
                break
            parts[where:where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        got = self.pair_cost.get((a, b))
        if got is None:
            if len(self.pair_cost) > MAX_PAIRS:
                self.pair_cost.clear()
            got = self.pair_cost[a, b] = self.merged(a + b) == [a, b]
        return got

    # shortest paths -------------------------------------------------------------

    def shortest(self, s: str) -> list[str]:
        """Labels along the shortest path of the lattice over a normalised string."""
        return self._by_merges(s) if self.kind == BPE else self._by_scores(s)

    def _by_merges(self, s: str) -> list[str]:
        path: list[str] = []
        left = [iter(self.arcs(s, 0))] if s else []
        at, dead = 0, set()
        while at < len(s):
            for arc in left[-1]:
                if (at, arc) in dead:
                    continue
                if not path:
                    ok = self.merged(arc) == [arc]
                else:
                    ok = self.compatible(path[-1], arc)
                if ok:
                    path.append(arc)
                    at += len(arc)
                    if at < len(s):
                        left.append(iter(self.arcs(s, at)))
                    break
            else:  # no finite arc goes on from here
                left.pop()
                if not path:
                    raise ValueError(f"no path over {s!r}")
                arc = path.pop()
                at -= len(arc)
                dead.add((at, arc))
        return path

    def _by_scores(self, s: str) -> list[str]:
        cost = [0.0] + [float("inf")] * len(s)
        back = [""] * (len(s) + 1)
        for at in range(len(s)):
            for arc in self.arcs(s, at):
                c = cost[at] - self.score.get(arc, -self.unknown_cost)
                if c < cost[at + len(arc)]:
                    cost[at + len(arc)], back[at + len(arc)] = c, arc
        path, at = [], len(s)
        while at:
            path.append(back[at])
            at -= len(back[at])
        return path[::-1]

    # whole texts ------------------------------------------------------------------

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text; chunks that begin with the mark are searched one
        by one and remembered, as no piece reaches over such a border."""
        chunks: list[str] = []
        per_text = []
        for t in texts:
            s = self.normalise(t)
            found = _CHUNK.findall(s) if self.cuttable and self.kind == BPE else [s] * bool(s)
            chunks += found
            per_text.append(len(found))
        if not chunks:
            return [np.empty(0, np.int32)] * len(texts)
        return _cut(*self.table.encode_words(chunks), per_text)

    def decode(self, ids) -> str:
        """Text of an id sequence; broken byte runs give replacement characters."""
        out = bytearray()
        for i in ids:
            if i in self.byte_of:
                out.append(self.byte_of[i])
            elif i not in self.quiet:
                out += self._utf8[i]
        text = out.decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text

    @functools.cached_property
    def _utf8(self) -> list[bytes]:
        return [p.replace(MARK, " ").encode() if i != self.unk else " ⁇ ".encode() for i, p in enumerate(self.pieces)]


@functools.lru_cache(maxsize=4)
def transducer(path: str) -> Transducer:
    """The worker's machine for a model file (kept between tasks)."""
    return Transducer(path)


def _encode(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = transducer(path)
        for pdf in text_chunks(batches):
            ids = machine.encode([t or "" for t in pdf["text"]])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": ids, "n_tokens": [len(x) for x in ids]})
    return run


def _decode(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = transducer(path)
        for pdf in batches:
            yield pdf.drop(columns="ids").assign(text=[
                None if x is None else machine.decode(x.tolist()) for x in pdf["ids"]])
    return run


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """``(doc_id, ids, n_tokens)`` of every text (null: no ids).

    Repeated rows are encoded each by itself, a null id stays null, an empty
    table gives no rows, other columns of ``docs`` are ignored.
    """
    src = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    return src.mapInPandas(_encode(path or vocabulary_path("piece_bpe_32k.model")),
                           "doc_id long, ids array<int>, n_tokens long")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, text)`` of id sequences (null: null text)."""
    return encoded.select("doc_id", "ids").mapInPandas(
        _decode(path or vocabulary_path("piece_bpe_32k.model")), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, n_byte_tokens, ids_crc32, n_chars, decoded_equal)``:
    every text encoded and decoded in one pass, as a digest (the CRC is over
    little-endian unsigned 32-bit ids).  ``decoded_equal`` is false for texts
    that hold the white-space mark itself; nulls count as empty texts."""
    place = path or vocabulary_path("piece_bpe_32k.model")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = transducer(place)
        for pdf in text_chunks(batches):
            texts = [t or "" for t in pdf["text"]]
            rows = []
            is_byte = np.zeros(len(machine.pieces), bool)
            is_byte[list(machine.byte_of)] = True
            for doc, text, ids in zip(pdf["doc_id"], texts, machine.encode(texts)):
                rows.append((doc, len(ids), int(is_byte[ids].sum()), zlib.crc32(ids.astype("<u4").tobytes()), len(text),
                             machine.decode(ids.tolist()) == text))
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "n_byte_tokens", "ids_crc32", "n_chars",
                                              "decoded_equal"])

    src = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    return src.mapInPandas(run, "doc_id long, n_tokens long, n_byte_tokens long, ids_crc32 long, n_chars long, "
                                "decoded_equal boolean")
