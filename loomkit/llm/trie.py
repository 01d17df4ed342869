"""Prefix trie of conversations from vertical bitmaps.

Turns become digests, and a conversation becomes rows of at most ``CHUNK``
consecutive turns that know the key of the prefix before them (exclusive or of
position-salted hashes, so a prefix of any length is a running value).  A shard
is a run of at most ``SHARD`` conversations in id order.  Per shard, (position,
turn) is an index to the bitset of its conversations; depth-first intersection
of the parent's bitset with these postings yields children, popcounts, smallest
members and end lists.  Nodes of different shards meet by key.  Sums over
subtrees need no walk: every node adds its value to its smallest member, and a
suffix sum along each conversation hands it to all prefixes above.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomkit.functions.prefix import prefix_sums
from loomkit.llm.common import materialise

SHARD, CHUNK = 4096, 64
RANGES = 48  # ranges of the turn order, so many tasks share the largest conversation
KEY = ["depth", "k1", "k2"]
_TURN = "array<struct<depth:bigint,h1:bigint,h2:bigint,words:bigint>>"


def ordered_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """``(conv, pos, digest, words)``: turns numbered from 1 in their conversation.

    Order: turn number, null first, ties by digest; repeated rows are turns of
    their own.  Null roles and texts are empty; rows without a conversation id
    are left out.  Ranks are prefix sums over ranges of the order, so one
    conversation with very many turns is dealt over many tasks.
    """
    role, text = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    told = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).isNotNull().cast("int").alias("known"),
        F.coalesce(F.col(turn).cast("long"), F.lit(0)).alias("turn"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    once = materialise(told.groupBy("conv", "known", "turn", "digest")
                       .agg(F.max("words").alias("words"), F.count(F.lit(1)).alias("c")), "turns")
    placed = prefix_sums(once, ["known", "turn", "digest"], ["c"], prefix="before_", buckets=RANGES,
                         group_cols=["conv"])
    return materialise(placed.select(
        "conv", F.explode(F.sequence(F.col("before_c") + 1, F.col("before_c") + F.col("c"))).alias("pos"),
        "digest", "words"), "ordered")


def whole_conversations(ordered: DataFrame) -> DataFrame:
    """``(conv, turns)`` rows for ``prefix_trie``: every conversation as it is."""
    return _pieces(ordered.select("conv", F.col("pos").alias("k"), "digest", "words"))


def shared_openings(ordered: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Conversations rebuilt on shared openings, as rows for ``prefix_trie``.

    Conversation c gets the first h turns of conversation c - c % every (fewer
    if it has fewer, none if it is absent) in place of its own first h turns;
    h is the unsigned crc32 of c in decimal, modulo ``most``.  A rebuilt
    conversation may have no turns at all.
    """
    conv = F.col("conv")
    h = F.crc32(conv.cast("string")) % most
    turn = F.struct(F.col("pos").alias("depth"), "digest", "words")
    heads = ordered.where((conv % every == 0) & (F.col("pos") < most)).groupBy(conv.alias("base")) \
        .agg(F.array_sort(F.collect_list(turn)).alias("head"))  # fewer than ``most`` turns each
    ids = ordered.groupBy("conv").agg(F.lit(1).alias("_one")).select("conv", (conv - conv % every).alias("base"))
    opened = ids.join(heads, "base", "left").select("conv", F.coalesce(F.filter(
        "head", lambda t: t["depth"] <= h), F.array().cast("array<struct<depth:bigint,digest:string,words:bigint>>"))
        .alias("head"))
    own = _pieces(ordered.where(F.col("pos") > h)
                  .select("conv", (F.col("pos") - h).alias("k"), "digest", "words"))
    m = F.size("head").cast("long")
    return opened.join(own, "conv", "left").select("conv", F.concat(
        F.when(F.coalesce("piece", F.lit(0)) == 0, F.col("head")).otherwise(F.slice("head", 1, 0)),
        F.coalesce(F.transform("turns", lambda t: F.struct((t["depth"] + m).alias("depth"), t["digest"].alias("digest"),
                                                           t["words"].alias("words"))),
                   F.slice("head", 1, 0))).alias("turns"))


def _pieces(turns: DataFrame) -> DataFrame:
    """``(conv, piece, turns)``: at most ``CHUNK`` consecutive turns a row."""
    turn = F.struct(F.col("k").alias("depth"), "digest", "words")
    return turns.groupBy("conv", F.expr(f"(k - 1) div {CHUNK}").alias("piece")) \
        .agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def _salted(salt: int, t: Column) -> Column:
    return F.xxhash64(F.lit(salt), t["depth"], t["digest"])


def _xor(turns: str, name: str) -> Column:
    return F.aggregate(turns, F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(t[name]))


def _chunks(conversations: DataFrame) -> DataFrame:
    """``(conv, chunk, turns, total, k1, k2)``: turns cut at multiples of ``CHUNK``,
    with the key of the prefix before; a conversation without turns has one row."""
    hashed = F.transform("turns", lambda t: F.struct(
        t["depth"].alias("depth"), _salted(1, t).alias("h1"), _salted(2, t).alias("h2"), t["words"].alias("words")))
    chunk_of = lambda c: F.floor((c - 1) / CHUNK)
    rows = conversations.select("conv", hashed.cast(_TURN).alias("turns"))
    first = F.coalesce(chunk_of(F.try_element_at("turns", F.lit(1))["depth"]), F.lit(0))
    last = F.coalesce(chunk_of(F.try_element_at("turns", F.lit(-1))["depth"]), F.lit(0))
    cut = rows.select("conv", "turns", F.explode(F.sequence(first, last)).alias("chunk")) \
        .select("conv", "chunk", F.filter("turns", lambda t: chunk_of(t["depth"]) == F.col("chunk")).alias("turns"))
    # rows of a conversation meet a chunk from two sides at most
    whole = cut.groupBy("conv", "chunk").agg(F.array_sort(F.flatten(F.collect_list("turns"))).alias("turns"))
    whole = whole.select("*", _xor("turns", "h1").alias("x1"), _xor("turns", "h2").alias("x2"),
                         F.size("turns").cast("long").alias("size"))
    of_conv = Window.partitionBy("conv")
    before = of_conv.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return whole.select("conv", "chunk", "turns", F.sum("size").over(of_conv).alias("total"),
                        *[F.coalesce(F.bit_xor(f"x{i}").over(before), F.lit(0)).alias(f"k{i}") for i in (1, 2)])


def _bits(rows: list[int]) -> int:
    if len(rows) < 8:
        return sum(1 << r for r in rows)
    mask = np.zeros(rows[-1] + 1, np.uint8)
    mask[rows] = 1
    return int.from_bytes(np.packbits(mask, bitorder="little").tobytes(), "little")


def _members(bits: int) -> np.ndarray:
    raw = np.frombuffer(bits.to_bytes(-(-bits.bit_length() // 8), "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little"))


def _shard(pdf: pd.DataFrame) -> list[tuple]:
    """Nodes of the conversations of one shard, one chunk of positions deep."""
    conv, total = pdf["conv"].to_numpy(), pdf["total"].to_numpy()
    start = int(pdf["chunk"].iloc[0]) * CHUNK
    turns = [[(t["h1"], t["h2"], t["words"]) for t in ts] for ts in pdf["turns"]]
    postings, starts, ends, longer = defaultdict(list), defaultdict(list), defaultdict(list), defaultdict(list)
    for r, ts in enumerate(turns):
        starts[int(pdf["k1"].iat[r]), int(pdf["k2"].iat[r])].append(r)
        for i, (h1, h2, _) in enumerate(ts):
            postings[start + i + 1, h1, h2].append(r)
            longer[start + i].append(r)  # has a turn behind this depth
        if total[r] == start + len(ts):
            ends[int(total[r])].append(r)
    postings, ends, longer = ({k: _bits(v) for k, v in d.items()} for d in (postings, ends, longer))
    nodes = []

    def tell(depth, key, parent, bits, words):
        done = bits & ends.get(depth, 0)
        ids = conv[_members(done)] if done else None
        nodes.append((depth, *key, *parent, bits.bit_count(), conv[(bits & -bits).bit_length() - 1], words,
                      None if ids is None else ids[0], None if ids is None else ids.astype("<i8").tobytes()))

    todo = []
    for key, rows in starts.items():
        bits = _bits(rows)
        if not start:
            tell(0, key, (None, None), bits, 0)
        todo.append((start, key, bits))
    while todo:
        depth, key, bits = todo.pop()
        rest = bits & longer.get(depth, 0)
        while rest:
            h1, h2, words = turns[(rest & -rest).bit_length() - 1][depth - start]
            child = rest & postings[depth + 1, h1, h2]
            rest ^= child
            to = (key[0] ^ h1, key[1] ^ h2)
            tell(depth + 1, to, key, child, words)
            todo.append((depth + 1, to, child))
    return nodes


_NODES = "depth long, k1 long, k2 long, p1 long, p2 long, n_convs long, conv_id long, words long, low long, ends binary"


def _shards(shard: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            chunk = pdf["chunk"].to_numpy()
            cuts = [0, *(np.flatnonzero(chunk[1:] != chunk[:-1]) + 1), len(pdf)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                for c in range(a, b, shard):
                    rows = zip(*_shard(pdf.iloc[c:min(b, c + shard)]))
                    yield pd.DataFrame({f.split()[0]: pd.array(v, dtype="Int64" if f.endswith("long") else object)
                                        for f, v in zip(_NODES.split(", "), rows)})
    return run


def _end_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of every node's end list, streamed: lists of a node come by first
    id, so ids below the next list's first id are final."""
    key = sha = wait = None

    def put(ids: np.ndarray) -> None:
        nonlocal empty
        if len(ids):
            sha.update(((b"" if empty else b",") + ",".join(map(str, ids.tolist())).encode()))
            empty = False

    empty = True
    for pdf in batches:
        out = []
        for *k, low, raw in pdf[[*KEY, "low", "ends"]].itertuples(index=False):
            ids = np.frombuffer(raw, "<i8")
            if key != k:
                if key is not None:
                    put(wait)
                    out.append((*key, sha.hexdigest()))
                key, sha, empty, wait = k, hashlib.sha256(), True, ids
                continue
            put(wait[wait < low])
            wait = np.sort(np.concatenate([wait[wait >= low], ids]))
        yield pd.DataFrame(out, columns=[*KEY, "ends_sha256"])
    if key is not None:
        put(wait)
        yield pd.DataFrame([(*key, sha.hexdigest())], columns=[*KEY, "ends_sha256"])


def _handed_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What each conversation's own nodes add to the prefixes above them."""
    for pdf in batches:
        out = []
        for chunk, turns, k1, k2, own, saved, leaves in pdf[
                ["chunk", "turns", "k1", "k2", "own", "later_saved", "later_leaves"]].itertuples(index=False):
            own = {} if own is None else {o["depth"]: (o["saved"], o["leaf"]) for o in own}
            if not (own or saved or leaves):
                continue
            keys = [] if chunk else [(0, 0, 0)]
            for t in turns:
                k1, k2 = k1 ^ t["h1"], k2 ^ t["h2"]
                keys.append((t["depth"], k1, k2))
            for key in reversed(keys):
                more = own.get(key[0], (0, 0))
                saved, leaves = saved + more[0], leaves + more[1]
                if saved or leaves:
                    out.append((*key, saved, leaves))
        yield pd.DataFrame(out, columns=[*KEY, "saved_tokens", "n_leaves"], dtype=np.int64)


def prefix_trie(conversations: DataFrame, shard: int = SHARD) -> DataFrame:
    """Nodes of the trie of all prefixes: ``conv_id`` (smallest member), ``depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``conversations`` has rows ``(conv, turns)``, consecutive turns of a
    conversation in any number of rows (``whole_conversations``,
    ``shared_openings``).  The root stands for no turns and has every
    conversation as member, those without turns included; an empty table has
    no nodes.  ``saved_tokens`` sums (members - 1) x words of the last turn
    over the subtree, ``ends_sha256`` is the digest of the ids, ascending, of
    the members without further turns.
    """
    chunks = materialise(_chunks(conversations), "chunks")
    parts = materialise(chunks.repartitionByRange("conv", "chunk").sortWithinPartitions("chunk", "conv")
                        .mapInPandas(_shards(shard), _NODES), "nodes")
    merged = parts.groupBy(*KEY).agg(F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"),
                                     F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.max("words").alias("words"))
    children = merged.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"),
                                                 F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialise(merged.join(children, KEY, "left").fillna(0, ["n_children"]), "merged")
    digests = parts.where("ends is not null").select(*KEY, "low", "ends").repartition(*KEY) \
        .sortWithinPartitions(*KEY, "low").mapInPandas(
            _end_digests, "depth long, k1 long, k2 long, ends_sha256 string")

    own = nodes.groupBy(F.col("conv_id").alias("conv"),
                        F.floor(F.greatest(F.col("depth") - 1, F.lit(0)) / CHUNK).alias("chunk")) \
        .agg(F.collect_list(F.struct("depth", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
                                     (F.col("n_children") == 0).cast("long").alias("leaf"))).alias("own"))
    told = chunks.join(own, ["conv", "chunk"], "left")
    after = Window.partitionBy("conv").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    total = lambda name: F.coalesce(F.aggregate(
        "own", F.lit(0).cast("long"), lambda a, o: a + o[name]), F.lit(0))
    later = lambda name: F.coalesce(F.sum(name).over(after), F.lit(0))
    told = told.withColumn("_saved", total("saved")).withColumn("_leaves", total("leaf")) \
        .withColumn("later_saved", later("_saved")).withColumn("later_leaves", later("_leaves"))
    sums = told.select("chunk", "turns", "k1", "k2", "own", "later_saved", "later_leaves") \
        .mapInPandas(_handed_up, "depth long, k1 long, k2 long, saved_tokens long, n_leaves long") \
        .groupBy(*KEY).agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
                         F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(above, ["depth", "p1", "p2"], "left").join(sums, KEY, "left").join(digests, KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
