"""Prefix trie against a trie of Python dictionaries."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from loomkit.llm.trie import _end_digests, ordered_turns, prefix_trie, shared_openings, whole_conversations
from tests.llm.helpers import rows_of

COLS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id long, turn long, role string, text string"


def conversations(rows):
    told = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            told[c].append((turn is not None, turn or 0, tie, role, text))
    return {c: [t[3:] for t in sorted(ts)] for c, ts in told.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    kids = defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, ms in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(ms) - 1) * words
    return sorted(((ms[0], len(node), members[node[:-1]][0] if node else None, len(ms), kids[node], leaves[node],
                    saved[node], hashlib.sha256(",".join(str(c) for c in ms if len(convs[c]) == len(node))
                                                .encode()).hexdigest())
                   for node, ms in members.items()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns(
        {c: F.lit("clash") for c in ("conv", "pos", "depth", "digest", "words", "k1", "turns", "chunk")})


def random_rows(seed, n=120):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(400), n):
        for turn in range(rng.choice([1, 1, 2, 3, 5, 8])):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["a", "a b", "", "é  x\ty"])))
    return rows


def test_rebuilt_conversations_equal_brute_force(spark):
    for seed in (1, 2):
        rows = random_rows(seed)
        convs = rebuilt(conversations(rows))
        assert any(not c for c in convs.values())  # turnless ones are members of the root
        got = prefix_trie(shared_openings(ordered_turns(frame(spark, rows))), shard=16)
        assert rows_of(got, *COLS) == brute(convs)


def test_long_conversations_and_hot_openings(spark):
    rng, rows = random.Random(3), []
    for c in range(60):  # a hot opening of 70 turns, then long tails; one conversation of a third of all turns
        n = {7: 4000}.get(c, rng.choice([10, 64, 65, 130, 200]))
        rows += [(c, t, "user" if t % 2 else "assistant", "same" if t < 70 else f"tail {c % 5} {t}") for t in range(n)]
    convs = conversations(rows)
    small = {c: ts[:300] for c, ts in convs.items()}
    rows = [r for r in rows if r[1] < 300]
    assert rows_of(prefix_trie(whole_conversations(ordered_turns(frame(spark, rows))), shard=8), *COLS) == brute(small)
    assert rows_of(prefix_trie(shared_openings(ordered_turns(frame(spark, rows)))), *COLS) == brute(rebuilt(small))


def test_one_very_long_conversation(spark):
    rows = [(5, t, "user", f"w{t % 7}") for t in range(5000)] + [(6, t, "user", f"w{t % 7}") for t in range(3000)]
    got = {(r["conv_id"], r["depth"]): r for r in
           prefix_trie(whole_conversations(ordered_turns(frame(spark, rows)))).collect()}
    assert len(got) == 5001 and got[5, 3000]["n_convs"] == 2 and got[5, 3001]["n_convs"] == 1
    assert got[5, 0]["saved_tokens"] == 3000 and got[5, 2990]["saved_tokens"] == 11
    assert got[5, 3000]["ends_sha256"] == hashlib.sha256(b"6").hexdigest()


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(1, 0, None, None), (1, None, "user", "first"), (1, 2, "user", "x"), (1, 2, "user", "x"),
            (1, 2, "user", "a"), (2, 0, "", ""), (2, None, "user", "first"), (None, 0, "user", "lost"),
            (40, None, None, None), (41, 0, "user", "long " * 50_000)]
    assert rows_of(prefix_trie(shared_openings(ordered_turns(frame(spark, rows)))), *COLS) \
        == brute(rebuilt(conversations(rows)))


def test_empty_table(spark):
    assert prefix_trie(shared_openings(ordered_turns(frame(spark, [(1, 0, "a", "b")]).limit(0)))).count() == 0


def test_overlapping_end_lists_are_hashed_in_order(spark):
    import numpy as np
    import pandas as pd
    raw = lambda *ids: np.array(ids, "<i8").tobytes()
    pdf = pd.DataFrame([(1, 0, 0, 1, raw(1, 8, 30)), (1, 0, 0, 5, raw(5, 9)), (1, 0, 0, 20, raw(20, 40)),
                        (2, 0, 0, 3, raw(3))], columns=["depth", "k1", "k2", "low", "ends"])
    got = pd.concat(_end_digests(iter([pdf.iloc[:2], pdf.iloc[2:]])))
    assert got["ends_sha256"].tolist() == [hashlib.sha256(b"1,5,8,9,20,30,40").hexdigest(),
                                           hashlib.sha256(b"3").hexdigest()]
