"""Spelling variants: k-d trees over letter-count vectors.

One edit moves the letter counts of a word by L1 distance 2 (replacement: one
letter less, another more) or 1 (insertion: one letter more).  The words of one
length are the points of a k-d tree.  Its upper part is planned from a bounded
sample and cuts each length into cells; a word lies in one cell and is searched
for in every cell whose box it can reach by one edit, among the words of its
own length and of the next.  Each cell holds the lower part of the tree; box
pruning again leaves few leaves, and the letters of what is left are compared
in order.  The sample shapes the cells only, never the result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomkit.llm.common import materialise, spread, text_chunks

MIN_LENGTH, MIN_COUNT, FACTOR, ONE_IN = 6, 5, 5, 199
CELL = 4096          # words a cell is planned for
SAMPLE = 8192        # sampled words of one length at most, from which its cells are planned
FLUSH = 250_000      # words that a counting task holds before it hands them on
LEAF, DIMS, LEVELS = 48, 32, 3


def _letter_table() -> bytes:
    table = bytearray(b" " * 256)
    for code in (*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)):
        table[code] = code
    for code in range(ord("A"), ord("Z") + 1):
        table[code] = code + 32
    return bytes(table)


_LETTERS = _letter_table()
# a letter's dimension: a-z their own, the others share the rest (distances only shrink by that)
_DIM = np.array([c - 97 if 97 <= c < 123 else 26 + c % (DIMS - 26) for c in range(256)], np.int64)


def _counted(one_in: int, least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[bytes, int] = {}
        for pdf in text_chunks(batches):
            for doc, text in zip(pdf["doc"], pdf["text"]):
                if not text:
                    continue
                before = zlib.crc32(f"{doc}:".encode())
                # a code point above U+00FF becomes "?", which is no letter either
                for w, n in Counter(text.encode("latin-1", "replace").translate(_LETTERS).split()).items():
                    if len(w) < least:
                        continue
                    h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), before)
                    if not h % one_in:
                        h %= len(w)
                        w = w[:h] + w[h + 1:]
                    total[w] = total.get(w, 0) + n
            if len(total) > FLUSH:
                yield _counts(total)
                total = {}
        yield _counts(total)
    return run


def _counts(total: dict[bytes, int]) -> pd.DataFrame:
    return pd.DataFrame({"word": _strings(total), "n": np.fromiter(total.values(), np.int64, len(total))})


def _strings(words) -> np.ndarray:
    out = np.empty(len(words), object)
    out[:] = [w.decode("latin-1") for w in words]
    return out


def corpus_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int = ONE_IN,
                 min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``(word, n)``: the words of all texts and how often they occur.

    Where ``one_in`` divides the crc32 of ``<id>:<word>``, the occurrence is
    counted under the word without one letter.  A null text has no words, a
    null id is written as nothing, repeated rows count again.
    """
    src = spread(docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"),
                             F.col(text_col).alias("text")))
    parts = src.mapInPandas(_counted(one_in, min_length), "word string, n long")
    return parts.where(F.length("word") >= min_length).groupBy("word").agg(F.sum("n").alias("n")) \
        .where(F.col("n") >= min_count)


def letters(words: list[bytes]) -> np.ndarray:
    """Letters of words of one length, a row each."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def letter_counts(chars: np.ndarray) -> np.ndarray:
    """Count vectors, each count clipped at ``LEVELS`` (distances only shrink by that)."""
    m = len(chars)
    out = np.empty((m, DIMS), np.int8)
    step = max(1, (1 << 22) // max(1, chars.shape[1]))
    for a in range(0, m, step):
        part = _DIM[chars[a:a + step]] + np.arange(len(chars[a:a + step]))[:, None] * DIMS
        out[a:a + step] = np.minimum(np.bincount(part.ravel(), minlength=DIMS * len(part)), LEVELS).reshape(-1, DIMS)
    return out


class KdTree:
    """Points cut at medians of the widest dimension; ``leaves`` holds point numbers."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.cuts: list[tuple] = []  # (dimension, value, left, right); a leaf is (-1, its number, 0, 0)
        self.leaves: list[np.ndarray] = []
        self._grow(points, np.arange(len(points)), leaf)

    def _grow(self, points: np.ndarray, idx: np.ndarray, leaf: int) -> int:
        at = len(self.cuts)
        self.cuts.append((-1, len(self.leaves), 0, 0))
        v = points[idx]
        dim = int(v.var(0).argmax()) if len(idx) > leaf else 0
        low, high = (int(v[:, dim].min()), int(v[:, dim].max())) if len(idx) > leaf else (0, 0)
        if low == high:  # few points, or all alike
            self.leaves.append(idx)
            return at
        cut = min(int(np.median(v[:, dim])), high - 1)
        left = self._grow(points, idx[v[:, dim] <= cut], leaf)
        right = self._grow(points, idx[v[:, dim] > cut], leaf)
        self.cuts[at] = (dim, cut, left, right)
        return at

    def reach(self, q: np.ndarray, less: int) -> Iterator[tuple[int, np.ndarray]]:
        """``(leaf, queries)``: the leaves whose box a query enters by one letter
        more and ``less`` letters less."""
        none = np.zeros(len(q), np.int8)
        todo = [(0, np.arange(len(q)), none, none, {}, {})]
        while todo:
            at, idx, short, over, lo, hi = todo.pop()
            dim, cut, left, right = self.cuts[at]
            if dim < 0:
                yield cut, idx
                continue
            x = q[idx, dim]
            # letters that must go to get to the left, letters that must come to get to the right
            go = over + np.maximum(x - cut, 0) - np.maximum(x - hi.get(dim, LEVELS), 0)
            come = short + np.maximum(cut + 1 - x, 0) - np.maximum(lo.get(dim, 0) - x, 0)
            for child, ok, a, b, new_lo, new_hi in ((left, go <= less, short, go, lo, {**hi, dim: cut}),
                                                    (right, come <= 1, come, over, {**lo, dim: cut + 1}, hi)):
                if ok.any():
                    todo.append((child, idx[ok], a[ok], b[ok], new_lo, new_hi))


def _unary(v: np.ndarray) -> np.ndarray:
    """Counts as runs of ones: the dot product of two is the sum of the smaller counts."""
    return (v[:, :, None] > np.arange(LEVELS)).reshape(len(v), -1).astype(np.float32)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of letters differ by one replacement, or ``b`` by one inserted letter."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    n = a.shape[1]
    head, tail = a != b[:, :n], a != b[:, 1:]
    first = np.where(head.any(1), head.argmax(1), n)
    last = np.where(tail.any(1), n - 1 - tail[:, ::-1].argmax(1), -1)
    return last < first


class _Cell:
    """The words of one cell under the lower part of the tree."""

    def __init__(self, words: list[bytes], n: list[int]):
        self.words, self.n, self.chars = np.array(words, object), np.array(n, np.int64), letters(words)
        counts = letter_counts(self.chars)
        self.tree = KdTree(counts, LEAF)
        self.ones, self.size = _unary(counts), counts.sum(1, dtype=np.float32)

    def near(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(queries, points)`` one edit apart; ``chars`` are words of this length or one less."""
        q = letter_counts(chars)
        same = chars.shape[1] == self.chars.shape[1]
        ones, size = _unary(q), q.sum(1, dtype=np.float32)
        got = [(np.empty(0, np.int64),) * 2]
        for leaf, idx in self.tree.reach(q, 1 if same else 0):
            points = self.tree.leaves[leaf]
            for a in range(0, len(idx), 8192):
                part = idx[a:a + 8192]
                l1 = size[part][:, None] + self.size[points] - 2 * (ones[part] @ self.ones[points].T)
                i, j = np.nonzero(l1 <= (2 if same else 1))
                for b in range(0, len(i), 1 << 17):
                    x, y = part[i[b:b + (1 << 17)]], points[j[b:b + (1 << 17)]]
                    ok = one_edit(chars[x], self.chars[y])
                    got.append((x[ok], y[ok]))
        return tuple(np.concatenate(c) for c in zip(*got))


def _dealt(trees: dict):
    """Every word as a point of its cell, and as a query of the cells it can reach."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for size, part in pdf.groupby("size", sort=True):
                part = part.reset_index(drop=True)
                words = [w.encode("latin-1") for w in part["word"]]
                counts = letter_counts(letters(words))
                for target in (size, size + 1):
                    if target not in trees:
                        continue
                    tree = trees[target]
                    places = tree.reach(counts, 1 if target == size else 0) if tree else [(0, np.arange(len(words)))]
                    for cell, idx in places:
                        yield _rows(part.iloc[idx], target, cell, 1)
                home = [(0, np.arange(len(words)))] if not trees[size] else _home(trees[size], counts)
                for cell, idx in home:
                    yield _rows(part.iloc[idx], size, cell, 0)
    return run


def _rows(part: pd.DataFrame, target: int, cell: int, kind: int) -> pd.DataFrame:
    return pd.DataFrame({"target": target, "cell": cell, "kind": kind, "word": part["word"].to_numpy(object),
                         "n": part["n"].to_numpy(np.int64)})


def _home(tree: KdTree, counts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The one leaf of each point."""
    todo = [(0, np.arange(len(counts)))]
    while todo:
        at, idx = todo.pop()
        dim, cut, left, right = tree.cuts[at]
        if dim < 0:
            yield cut, idx
        else:
            low = counts[idx, dim] <= cut
            todo += [(c, i) for c, i in ((left, idx[low]), (right, idx[~low])) if len(i)]


def _searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cells come one after the other, their points first: a task holds one cell."""
    key, words, sizes, cell = None, [], [], None
    for pdf in batches:
        ids = pdf[["target", "cell", "kind"]].to_numpy()
        cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1), len(ids)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            if key != tuple(ids[a, :2]):
                key, words, sizes, cell = tuple(ids[a, :2]), [], [], None
            found = [w.encode("latin-1") for w in pdf["word"].iloc[a:b]]
            if not ids[a, 2]:
                words += found
                sizes += pdf["n"].iloc[a:b].tolist()
                continue
            if not words:  # a cell that the sample knew but no word lies in
                continue
            cell = cell or _Cell(words, sizes)
            n = pdf["n"].to_numpy(np.int64)[a:b]
            asked, order = np.array(found, object), np.array([len(w) for w in found])
            for size in (key[0], key[0] - 1):
                idx = np.flatnonzero(order == size)
                if len(idx):
                    q, p = cell.near(letters([found[i] for i in idx]))
                    q = idx[q]
                    yield _best(asked[q], cell.words[p], cell.n[p])
                    if size < key[0]:  # the longer word's side of the pair
                        yield _best(cell.words[p], asked[q], n[q])


def _best(word: np.ndarray, near: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    """Per word: how many near words, and the most frequent of them (ties: smallest)."""
    out = pd.DataFrame({"word": word, "near": near, "n": n}).sort_values(["word", "n", "near"],
                                                                       ascending=[True, False, True])
    first = out.drop_duplicates("word")
    count = out.groupby("word", sort=True).size()
    return pd.DataFrame({"word": _strings(first["word"]), "n_near": count.to_numpy(np.int64),
                         "form": _strings(first["near"]), "form_n": first["n"].to_numpy(np.int64)})


def plan_cells(words: DataFrame, cell: int = CELL, sample: int = SAMPLE) -> dict:
    """Per word length the upper part of its tree, or None where one cell will do.

    At most ``sample`` words of a length, drawn by a hash, reach the driver.
    """
    sizes = {r["size"]: r["c"] for r in words.groupBy("size").agg(F.count(F.lit(1)).alias("c")).collect()}
    big = {s: min(1.0, min(sample, 8 * -(-c // cell)) / c) for s, c in sizes.items() if c > cell}
    trees: dict = dict.fromkeys(sizes)
    if big:
        share = F.coalesce(*[F.when(F.col("size") == s, F.lit(f)) for s, f in sorted(big.items())])
        drawn = words.where(F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < share * (1 << 20)) \
            .select("size", "word").collect()
        for s in big:
            found = sorted(r["word"].encode("latin-1") for r in drawn if r["size"] == s)
            if found:
                trees[s] = KdTree(letter_counts(letters(found)), 8)
                trees[s].leaves = []  # tasks need the cuts only
    return trees


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int = ONE_IN,
                    min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, factor: int = FACTOR,
                    cell: int = CELL) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``corpus_words``.

    Words are near if they differ by one inserted, deleted or replaced letter.
    A word's form is its near word of largest ``n`` (ties: smallest), if that
    ``n`` is ``factor`` times its own at least; ``root`` follows forms to the
    last.  Tables without such words give no rows; other columns are ignored.
    """
    words = materialise(corpus_words(docs, id_col, text_col, one_in, min_length, min_count)
                        .withColumn("size", F.length("word")), "words")
    dealt = words.mapInPandas(_dealt(plan_cells(words, cell)),
                              "target int, cell int, kind int, word string, n long")
    pairs = dealt.repartition("target", "cell").sortWithinPartitions("target", "cell", "kind") \
        .mapInPandas(_searched, "word string, n_near long, form string, form_n long")
    best = pairs.groupBy("word").agg(F.sum("n_near").alias("n_near"),
                                     F.min(F.struct((-F.col("form_n")).alias("m"), "form")).alias("b"))
    formed = materialise(
        words.join(best, "word", "left")
        .select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), (-F.col("b.m")).alias("m"), "b.form")
        .withColumn("ok", F.coalesce(F.col("m") >= factor * F.col("n"), F.lit(False)))
        .select("word", "n", "n_near", F.when(F.col("ok"), F.col("form")).alias("form"),
                F.when(F.col("ok"), F.col("m")).alias("form_n")), "forms")
    # counts grow by the factor at every step: chains are short, and jumps double
    jump = materialise(formed.where("form is not null").select("word", F.col("form").alias("root")), "jumps")
    while True:
        after = jump.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if not jump.join(after, "root", "left_semi").limit(1).count():
            break
        jump = materialise(jump.join(after, "root", "left")
                           .select("word", F.coalesce("next", "root").alias("root")), "jumps")
    return formed.join(jump, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
