import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loomkit.llm.minhash import keep_one, minhash_groups, shingle_set, superminhash, union_find
from tests.llm.helpers import docs_frame, rows_of

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, width, threshold=80):
    sets = {}
    for d, t, *_ in rows:
        w = [x.translate(LOW) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets[d] = {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def planted():
    r = random.Random(5)
    text = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    rows, i = [], 0
    base = text(200)
    for _ in range(25):  # copies with a changed word, some far enough apart to link by others only
        t = list(base)
        for _ in range(r.randrange(0, 7)):
            t[r.randrange(200)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(t).upper() if i % 2 else "\n".join(t)))
        i += 1
    chain = text(120)
    for k in range(12):  # a chain: neighbours are similar, ends are not
        rows.append((i, " ".join(chain)))
        chain = chain[6:] + text(6)
        i += 1
    passage = text(60)
    for _ in range(20):  # a shared passage, otherwise different
        rows.append((i, " ".join(text(100) + passage)))
        i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \n\t"), (i + 3, "one two"), (i + 4, "One\ttwo"), (i + 5, "one"),
             (i + 6, "one two three"), (i + 7, "é" * 50_000), (i + 8, " ".join(["a b"] * 20_000))]
    return rows


def test_groups_equal_brute_force(spark):
    rows = planted()
    for width in (4, 5):
        want = brute(rows, width)
        got = {r.doc_id: r for r in minhash_groups(docs_frame(spark, rows), width=width).collect()}
        assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == want
        assert all(r.kept == (d == r.component_id) for d, r in got.items())


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F"), (None, "a b c d e f"), (3, None)]
    out = rows_of(minhash_groups(docs_frame(spark, rows)), "doc_id", "component_id", "kept")
    assert out == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True), (3, 3, True)], key=repr)
    assert minhash_groups(docs_frame(spark, [])).count() == 0
    kept = keep_one(docs_frame(spark, rows))
    assert {r.doc_id for r in kept.collect()} >= {1, 3} and 2 not in {r.doc_id for r in kept.collect()}
    assert kept.columns == docs_frame(spark, rows).columns


def test_union_find_over_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 120)] + [(7, 3), (119, 200)]
    got = {r.node: r.root for r in union_find(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in [*range(101, 120), 200]}


def test_superminhash_estimates_jaccard():
    r = np.random.default_rng(3)
    errors = []
    for share in (0.0, 0.3, 0.8, 1.0):
        n = 300
        a = r.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[:int(n * share)], r.integers(0, 2**63, n - int(n * share)).astype(np.uint64)])
        sig = superminhash(np.concatenate([a, b]), np.repeat([0, 1], n), 2, 200)
        both = len(np.intersect1d(a, b))
        errors.append(abs((sig[0] == sig[1]).mean() - both / (2 * n - both)))
    assert max(errors) < 0.1


@settings(max_examples=20, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**64 - 1), max_size=30, unique=True), min_size=1, max_size=6))
def test_signature_does_not_depend_on_neighbours_or_order(sets):
    flat = np.array([x for s in sets for x in s], np.uint64)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    whole = superminhash(flat, doc, len(sets), 16)
    for i, s in enumerate(sets):
        alone = superminhash(np.array(s[::-1], np.uint64), np.zeros(len(s), np.int64), 1, 16)
        assert (whole[i] == alone[0]).all()


def test_shingles_of_short_and_wordless_texts():
    assert len(shingle_set(None, 4)) == len(shingle_set(" \n", 4)) == 0
    assert len(shingle_set("a b", 4)) == 1
    assert (shingle_set("A b\tC", 4) == shingle_set("a B c", 4)).all()
    assert (shingle_set("ab", 4) != shingle_set("a b", 4)).all()
