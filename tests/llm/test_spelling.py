"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from loomkit.llm.common import table
from loomkit.llm.spelling import KdTree, letter_counts, letters, one_edit, spelling_groups
from tests.conftest import SMALL
from tests.llm.helpers import docs_frame, rows_of

COLS = ("word", "form", "root", "n", "n_near", "form_n")


def edit_apart(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(docs):
    count = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            count[w] += 1
    n = {w: c for w, c in count.items() if len(w) >= 6 and c >= 5}
    near = {w: [v for v in n if v != w and edit_apart(v, w)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: best[w] if w in best and n[best[w]] >= 5 * n[w] else None for w in n}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out, key=repr)


@pytest.mark.parametrize("cell", [4096, 64])
def test_the_small_table_equals_brute_force(spark, cell):
    docs = table(spark, SMALL, "documents")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sum(w[1] is not None for w in want) >= 20
    assert rows_of(spelling_groups(docs, cell=cell), *COLS) == want


def test_awkward_rows(spark):
    long_word = "abcé" * 20_000
    rows = [(1, "colour Colour COLOUR colour colour color " * 5), (1, "colour Colour COLOUR colour colour color " * 5),
            (2, None), (None, "colours " * 6 + "Étéété " * 6), (3, ""), (4, "colœur " * 9),
            (5, (long_word + " ") * 6 + (long_word[:-1] + " ") * 5), (6, "×÷abcdef " * 5 + "abcdef" * 2)]
    got = rows_of(spelling_groups(docs_frame(spark, rows)), *COLS)
    assert got == brute(rows)
    assert ("colour", None, "colour") in [g[:3] for g in got]
    assert any(len(g[0]) == len(long_word) and g[4] == 1 for g in got)


def test_no_words_no_rows(spark):
    assert rows_of(spelling_groups(docs_frame(spark, [(1, "one two"), (2, None)])), *COLS) == []
    assert rows_of(spelling_groups(docs_frame(spark, [(1, "")]).limit(0)), *COLS) == []


def test_every_word_an_edit_away_is_reached_by_the_tree():
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("aeinrsté", k=7)) for _ in range(1500)})
    raw = [w.encode("latin-1") for w in words]
    counts = letter_counts(letters(raw))
    tree = KdTree(counts, 16)
    assert sorted(np.concatenate(tree.leaves).tolist()) == list(range(len(words))) and len(tree.leaves) > 60
    tests = 0
    for less, asked in ((1, words), (0, sorted({w[:i] + w[i + 1:] for w in words[::9] for i in range(7)}))):
        q = letter_counts(letters([w.encode("latin-1") for w in asked]))
        found = set()
        for leaf, idx in tree.reach(q, less):
            points = tree.leaves[leaf]
            tests += len(points) * len(idx)
            found |= {(asked[i], words[j]) for i in idx for j in points}
        assert {(a, w) for a in asked for w in words if edit_apart(a, w)} <= found
    assert tests < 0.6 * len(words) * (len(words) + len(asked))


def test_letter_order_decides():
    a = letters([b"abcdef", b"abcdef", b"abcdef", b"abcdef"])
    assert one_edit(a, letters([b"abxdef", b"abcdef", b"bacdef", b"abcfed"])).tolist() == [True, False, False, False]
    assert one_edit(a, letters([b"xabcdef", b"abcdefx", b"abccdef", b"abxcdfe"])).tolist() == [True, True, True, False]


def test_roots_follow_chains_of_forms(spark):
    text = "abcdef " * 125 + "abcdeg " * 25 + "abcdhg " * 5
    got = {r["word"]: (r["form"], r["root"]) for r in spelling_groups(docs_frame(spark, [(1, text)]),
                                                                      one_in=10 ** 10).collect()}
    assert got == {"abcdef": (None, "abcdef"), "abcdeg": ("abcdef", "abcdef"), "abcdhg": ("abcdeg", "abcdef")}
