"""Word-cached encoders over public vocabularies.

A corpus repeats its words, so each Python worker keeps a bounded table from
word to ids and encodes a word with the tokenizer only once.  Ids of a text are
then a ragged gather in numpy.  Texts for which cutting at white space could
change the ids go to the tokenizer whole, so the ids always equal its own.
"""

from __future__ import annotations

import functools
import os
import re
from array import array
from collections.abc import Callable
from itertools import chain

import numpy as np
import regex

MAX_WORDS = 450_000  # entries per worker; a full table is cleared and refilled
MAX_PIECES = 500_000  # pieces of words, held as packed ids


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers
    return public_tokenizers.path(name)


class _Codes(dict):
    """Number of every word seen; a new word gets the next number and waits."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n


class WordTable:
    """Ids of words, as offsets into one growing array.

    ``encode`` maps words to their ids in one flat list, and the count of each.
    """

    def __init__(self, encode: Callable[[list[str]], tuple], max_words: int = MAX_WORDS):
        self.encode, self.max_words = encode, max_words
        self.clear()

    def clear(self) -> None:
        self.code = _Codes()
        self.start = np.zeros(1024, np.int64)
        self.ids = np.zeros(4096, np.int32)
        self.known = self.used = 0

    def _add(self, words: list[str]) -> None:
        flat, size = self.encode(words)
        n = self.known
        if len(self.start) < n + len(words) + 1:
            self.start = np.resize(self.start, 2 * (n + len(words) + 1))
        if len(self.ids) < self.used + len(flat):
            self.ids = np.resize(self.ids, 2 * (self.used + len(flat)))
        self.ids[self.used:self.used + len(flat)] = flat
        self.start[n + 1:n + 1 + len(words)] = self.used + np.cumsum(np.array(size, np.int64))
        self.used += len(flat)
        self.known += len(words)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, ids per word)`` of the words, in order."""
        if self.known > self.max_words:
            self.clear()
        code = np.fromiter(map(self.code.__getitem__, words), np.int64, len(words))
        if self.code.new:
            self._add(self.code.new)
            self.code.new = []
        lo, size = self.start[code], self.start[code + 1] - self.start[code]
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        at = np.arange(total) + np.repeat(lo - (end - size), size)
        return self.ids[at], size


def flatten(found: list) -> tuple[list[int], list[int]]:
    """One flat list of the ids of several words, and the count of each."""
    return list(chain.from_iterable(found)), list(map(len, found))


def _cut(ids: np.ndarray, size: np.ndarray, per_text: list[int]) -> list[np.ndarray]:
    ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(per_text)])]
    return [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]


# The pre-tokenizer pattern of the vocabulary file, and the
# one-to-one naming of bytes by printable characters of byte-level vocabularies.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
# a final sigma, and white space on which libraries differ
_OTHER = "\u03a3\u1e9e\u0130\x1c-\x1f\x85\u180e\u200b-\u200f\u2028\u2029\ufeff"


@functools.cache
def _unsettled() -> re.Pattern:
    """``_OTHER``, and the characters that are letters or numbers in one
    library's Unicode tables and unassigned in an older one's."""
    import sys
    import unicodedata
    every = "".join(map(chr, range(256, sys.maxunicode + 1)))
    new = [m for m in regex.finditer(r"[\p{L}\p{N}]", every) if unicodedata.category(m[0]) == "Cn"]
    spans, last = [], None
    for code in (ord(m[0]) for m in new):
        if last is not None and code == last + 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
        last = code
    return re.compile("[" + _OTHER + "".join(f"{chr(a)}-{chr(b)}" for a, b in spans) + "]")


def _words_of(text: str) -> list[str] | None:
    """Words of a text that may be cut at white space, None for one that may not."""
    if "<|" in text:  # it may hold a special token's string
        return None
    try:
        raw = text if text.isascii() else text.encode("latin-1")
    except UnicodeEncodeError:  # each character once: the class is long
        if _unsettled().search("".join(set(text))):
            return None
        import unicodedata
        return unicodedata.normalize("NFC", text).lower().split()
    # the first 256 characters are normalised as they are
    if raw is not text and b"\x85" in raw or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return None
    return text.lower().split()


@functools.cache
def _byte_names() -> dict[int, str]:
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordBpe:
    """Ids of the word-end BPE vocabulary, equal to ``Tokenizer.encode(...).ids``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.pieces: dict[str, bytes] = {}
        self.table = WordTable(self._words)

    def _piece(self, piece: str) -> bytes:
        if not (piece.isascii() and piece.isprintable()):
            piece = piece.encode().decode("latin-1").translate(_byte_names())
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.pieces) > MAX_PIECES:
            self.pieces.clear()
        parts, known = [], self.pieces
        for w in words:
            if w.isalpha():
                found = (w,)
            elif w[-1] in ",." and w[:-1].isalpha():  # most of the rest
                found = (w[:-1], w[-1])
            else:
                found = _PIECES.findall(w)
            ids = b""
            for p in found:
                got = known.get(p)
                if got is None:
                    got = known[p] = self._piece(p)
                ids += got
            parts.append(ids)
        return np.frombuffer(b"".join(parts), np.uint32), np.fromiter(map(len, parts), np.int64, len(parts)) // 4

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        words: list[str] = []
        per_text, whole = [], {}
        for i, t in enumerate(texts):
            w = _words_of(t)
            if w is None:
                w = []
                whole[i] = np.asarray(self.whole.encode(t, add_special_tokens=False).ids, np.int32)
            words += w
            per_text.append(len(w))
        out = _cut(*self.table.encode_words(words), per_text) if words else [np.empty(0, np.int32)] * len(texts)
        for i, ids in whole.items():
            out[i] = ids
        return out


class PieceBpe:
    """Ids of the sentencepiece vocabulary, equal to ``encode(text)``.

    No piece holds a white-space mark behind another character, so a text of
    single blanks is encoded word by word; other texts go whole.
    """

    def __init__(self, path: str):
        import sentencepiece
        self.whole = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.whole.vocab_size()
        self.is_byte = np.array([self.whole.is_byte(i) for i in range(n)])
        self.table = WordTable(lambda words: flatten(self.whole.encode(words, num_threads=1)))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        words: list[str] = []
        per_text, whole = [], {}
        for i, t in enumerate(texts):
            if not t or t[0] == " " or t[-1] == " " or "  " in t or "▁" in t or "\0" in t:
                w = []
                whole[i] = np.asarray(self.whole.encode(t, num_threads=1), np.int32)
            else:
                w = t.split(" ")
            words += w
            per_text.append(len(w))
        out = _cut(*self.table.encode_words(words), per_text) if words else [np.empty(0, np.int32)] * len(texts)
        for i, ids in whole.items():
            out[i] = ids
        return out


_KEPT: dict = {}  # the one encoder that this worker holds between tasks


def release_tables() -> None:
    """Free the worker's word table: workers live on from stage to stage, and a
    stage that encodes nothing has no use for it."""
    _KEPT.clear()


def _kept(kind, path: str):
    if (kind, path) not in _KEPT:
        release_tables()
        _KEPT[kind, path] = kind(path)
    return _KEPT[kind, path]


def word_bpe(path: str) -> WordBpe:
    """The worker's encoder for a vocabulary file (kept between tasks)."""
    return _kept(WordBpe, path)


def piece_bpe(path: str) -> PieceBpe:
    return _kept(PieceBpe, path)
