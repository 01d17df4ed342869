"""Near-duplicate documents: SuperMinHash, banding, verification, union-find.

1. Every document becomes the set of its distinct word shingles (64-bit codes)
   inside one Arrow task; documents with equal sets share a class, and only the
   class's smallest id goes on.
2. SuperMinHash: each element draws, rank by rank, a slot of its own random
   permutation and offers ``rank + fraction`` there; a document stops as soon
   as every slot holds a value below the next rank.  The ranks make the slots
   of one element distinct, so signatures vary less than plain MinHash.
3. ``bands`` bands of ``rows`` slots: equal bands are candidates.
4. Verification on full sets, in rounds, so that no bucket is expanded into
   pairs: (a) a document against the smallest id it shares any bucket with,
   (b) against the smallest id of every bucket it is in, (c) documents whose
   bucket still holds several components, every pair of different components
   that shares a shingle of both prefixes (an exact filter, see
   ``_prefix_pairs``).  Pairs inside one component need no test: they cannot
   change the result.
5. Union-find over verified links: roots hook onto smaller roots, paths are
   halved by pointer jumping; every step is a join over node tables written to
   the shared folder.

A pair at the threshold 0.8 shares no band with probability
``(1 - 0.8**rows)**bands`` (1.2e-7 with 5 and 40), less above it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomkit.llm.common import materialise, mix64, spread, text_chunks, windows64, words_of
from loomkit.llm.tokens import release_tables

_TOP = np.uint64(2**64 - 1)
_32 = np.uint64(32)
_LOW = np.uint64(0xFFFFFFFF)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit codes of the word ``width``-grams of a text.

    A-Z are lower-cased; a text with fewer words gives its whole word sequence
    as one shingle, a text without words (or null) the empty set.
    """
    words = [w.lower() for w in words_of(text)] if text else []
    if not words:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < width:
        return windows64(np.append(codes, np.uint64(len(words))), len(words) + 1)
    return np.unique(windows64(codes, width))


def superminhash(values: np.ndarray, doc: np.ndarray, n_docs: int, slots: int,
                 seed: int = 0) -> np.ndarray:
    """Signatures (``n_docs`` x ``slots``, uint64 ``rank << 32 | fraction``).

    ``values`` holds the elements of all documents, ``doc`` the row each
    belongs to.  Documents without elements keep the largest value.
    """
    sig = np.full((n_docs, slots), _TOP, np.uint64)
    flat = sig.reshape(-1)
    state = mix64(values + np.uint64(seed))
    doc = doc.astype(np.int64)
    perm = np.tile(np.arange(slots, dtype=np.uint16 if slots > 256 else np.uint8), (len(values), 1))
    done = np.bincount(doc, minlength=n_docs) == 0
    for rank in range(slots):
        if not len(state):
            break
        x = mix64(state + np.uint64((rank + 1) * 0x9E3779B97F4A7C15 % 2**64))
        k = (rank + (((x & _LOW) * np.uint64(slots - rank)) >> _32)).astype(np.int64)
        at = np.arange(len(state))
        slot = perm[at, k].astype(np.int64)
        perm[at, k] = perm[:, rank]
        np.minimum.at(flat, doc * slots + slot, (np.uint64(rank) << _32) | (x >> _32))
        live = np.flatnonzero(~done)
        ended = live[sig[live].max(axis=1) < (np.uint64(rank + 1) << _32)]
        if len(ended):
            done[ended] = True
            keep = ~done[doc]
            state, doc, perm = state[keep], doc[keep], perm[keep]
    return sig


def band_codes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit code per band; the band's number is part of the code."""
    out = np.tile(np.arange(bands, dtype=np.uint64), (len(sig), 1))
    cube = sig.reshape(len(sig), bands, rows)
    for i in range(rows):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + cube[:, :, i])
    return out


def _sketches(width: int, bands: int, rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release_tables()
        for pdf in text_chunks(batches):
            sets = [shingle_set(t, width) for t in pdf["text"]]
            size = np.array([len(s) for s in sets], np.int64)
            digest = [xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets]
            sig = superminhash(np.concatenate(sets) if sets else np.empty(0, np.uint64),
                               np.repeat(np.arange(len(sets)), size), len(sets), bands * rows)
            codes = band_codes(sig, bands, rows).view(np.int64)
            yield pd.DataFrame({
                "doc": pdf["doc"], "n": size, "digest": digest,
                "band": [c if s else None for c, s in zip(codes, size)]})
    return run


def _sets(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in text_chunks(batches):
            sets = [shingle_set(t, width) for t in pdf["text"]]
            yield pd.DataFrame({"doc": pdf["doc"], "items": [s.tobytes() for s in sets],
                                "bits": [parity_bits(s) for s in sets]})
    return run


PARITY_WORDS = 16  # 1,024 bits


def parity_bits(items: np.ndarray) -> np.ndarray:
    """Parity of the number of items on each of 1,024 hashed places.  Where two
    sets differ in d places, they differ in d items at least."""
    odd = np.bincount((mix64(items) % np.uint64(64 * PARITY_WORDS)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _links(threshold: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for a, b in zip(pdf["x"], pdf["y"]):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= threshold * (len(a) + len(b) - both))
            yield pdf.loc[np.array(keep, bool), ["u", "v"]]
    return run


def _tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        size = pdf["items"].str.len().to_numpy() // 8
        piece = np.cumsum(size) // 500_000
        for k in np.unique(piece):
            at = piece == k
            yield pd.DataFrame({c: np.repeat(pdf[c].to_numpy()[at], size[at]) for c in ("doc", "n", "comp")}).assign(
                token=np.frombuffer(b"".join(pdf["items"][at]), np.int64))


def _prefix_pairs(docs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs ``(u > v)`` of different components that can still reach the threshold.

    A shingle that one component alone holds cannot be shared with another.
    The rest are ordered from rare to common over the given documents.  Two
    sets that are similar enough share one among the first
    ``n - ceil(threshold * n) + 1`` of each (the lone ones counted first), so a
    passage that many documents repeat pairs none of them as long as they have
    enough shingles of their own; nor can they share more than the smaller
    number of shingles that are not alone, or than their parity bits allow.
    """
    tokens = materialise(sets.join(docs, "doc").select("doc", "n", "comp", "items")
                         .mapInPandas(_tokens, "doc long, n long, comp long, token long"), "tokens")
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("docs"), F.min("comp").alias("a"),
                                        F.max("comp").alias("b")).where("a < b").select("token", "docs")
    by_doc = Window.partitionBy("doc")
    first = tokens.join(often, "token") \
        .withColumn("shared", F.count(F.lit(1)).over(by_doc)) \
        .withColumn("place", F.row_number().over(by_doc.orderBy("docs", "token")) + F.col("n") - F.col("shared")) \
        .where(f"place <= n - ceil({threshold} * n / 100) + 1").select("token", "doc", "n", "comp", "shared")
    first = materialise(first.join(sets.select("doc", "bits"), "doc"), "prefixes")
    enough = "100 * least(s, s2) >= {t} * (m + m2 - least(s, s2)) and 100 * {big} >= {t} * m2 and 100 * {big2} >= {t} * m"
    parts = first.groupBy("token", "comp").agg(F.min("n").alias("m"), F.max("n").alias("most"),
                                               F.max("shared").alias("s"), F.count(F.lit(1)).alias("c"))
    other = parts.select("token", F.col("comp").alias("comp2"), F.col("m").alias("m2"),
                         F.col("most").alias("most2"), F.col("s").alias("s2"), F.col("c").alias("c2"))
    duos = parts.join(other, "token").where(  # the smaller part first, so that it is expanded first
        "(c < c2 or c = c2 and comp < comp2) and comp <> comp2 and "
        + enough.format(t=threshold, big="most", big2="most2")).select("token", "comp", "comp2")
    left = first.select("token", "comp", "doc", F.col("n").alias("m"), F.col("shared").alias("s"), "bits")
    right = first.select("token", F.col("comp").alias("comp2"), F.col("doc").alias("doc2"), F.col("n").alias("m2"),
                         F.col("shared").alias("s2"), F.col("bits").alias("bits2"))
    differ = "+".join(f"bit_count(bits[{i}] ^ bits2[{i}])" for i in range(PARITY_WORDS))
    return duos.join(left, ["token", "comp"]).join(right, ["token", "comp2"]) \
        .where(enough.format(t=threshold, big="m", big2="m2")) \
        .where(f"({differ}) * {100 + threshold} <= {100 - threshold} * (m + m2)") \
        .select(F.greatest("doc", "doc2").alias("u"), F.least("doc", "doc2").alias("v")).distinct()


def _verify(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Of the pairs (u > v), those whose full sets are similar enough."""
    left = pairs.join(sets.select(F.col("doc").alias("u"), F.col("items").alias("x")), "u")
    both = left.join(sets.select(F.col("doc").alias("v"), F.col("items").alias("y")), "v")
    return both.select("u", "v", "x", "y").mapInPandas(_links(threshold), "u long, v long")


def _flatten(parent: DataFrame) -> DataFrame:
    """Pointer jumping: ``(node, root)`` where every root is its own parent's end."""
    while True:
        up = parent.select(F.col("node").alias("root"), F.col("root").alias("_up"))
        step = materialise(
            parent.join(up, "root", "left").select(
                "node", F.coalesce("_up", "root").alias("root"),
                F.col("_up").isNotNull().alias("moved")), "jump")
        parent = step.select("node", "root")
        if not step.where("moved").limit(1).count():
            return parent


def union_find(links: DataFrame) -> DataFrame:
    """``(node, root)`` of every linked node that is not its component's
    smallest; ``links`` has columns ``u`` and ``v`` in any order."""
    edges = materialise(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                        .where("u > v").distinct(), "links")
    done = None
    while edges.limit(1).count():
        hooks = _flatten(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")))
        done = hooks if done is None else materialise(
            _lifted(done, hooks).unionByName(hooks), "roots")
        at_u = hooks.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        at_v = hooks.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        edges = materialise(
            edges.join(at_u, "u", "left").join(at_v, "v", "left")
            .select(F.coalesce("ru", "u").alias("a"), F.coalesce("rv", "v").alias("b"))
            .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
            .where("u > v").distinct(), "links")
    if done is None:
        return links.select(F.col("u").alias("node"), F.col("v").alias("root")).where("false")
    return done


def _lifted(roots: DataFrame, hooks: DataFrame) -> DataFrame:
    up = hooks.select(F.col("node").alias("root"), F.col("root").alias("_up"))
    return roots.join(up, "root", "left").select("node", F.coalesce("_up", "root").alias("root"))


def _rooted(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return members.withColumn("comp", F.col("doc"))
    return members.join(roots.select(F.col("node").alias("doc"), F.col("root").alias("_r")), "doc", "left") \
        .withColumn("comp", F.coalesce("_r", "doc")).drop("_r")


def minhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   width: int = 5, threshold: int = 80, bands: int = 40, rows: int = 5) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every document.

    Two documents are linked when ``100 * |A & B| >= threshold * |A | B|`` over
    their shingle sets; ``component_id`` is the smallest id reachable.  Null,
    empty and wordless texts have an empty set and stand alone.  Rows that
    repeat an id with the same text are copies of one another (both are kept);
    an id must not come with different texts.  A null id is linked with
    nothing, has a null component and is kept.  An empty table gives no rows;
    other columns of ``docs`` are ignored.
    """
    src = spread(docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")))
    sketch = materialise(src.mapInPandas(
        _sketches(width, bands, rows), "doc long, n long, digest string, band array<long>"), "sketch")
    known = sketch.where("digest is not null and doc is not null")
    classes = known.groupBy("digest").agg(F.min("doc").alias("rep"))
    reps = known.join(classes, "digest").where("doc = rep")
    spots = reps.select("doc", "n", F.explode("band").alias("bucket")).distinct()
    shared = spots.groupBy("bucket").agg(F.min("doc").alias("low"), F.max("doc").alias("high")) \
        .where("low < high").select("bucket", "low")
    members = materialise(spots.join(shared, "bucket"), "members")

    involved = members.select("doc").distinct()
    sets = materialise(src.join(involved, "doc", "left_semi")
                       .mapInPandas(_sets(width), "doc long, items binary, bits array<long>"), "sets")

    first = members.where("low < doc").groupBy(F.col("doc").alias("u")).agg(F.min("low").alias("v"))
    links = materialise(_verify(first, sets, threshold), "round1")
    roots = union_find(links)

    rooted = _rooted(members, roots)
    mixed = rooted.groupBy("bucket").agg(F.min("comp").alias("a"), F.max("comp").alias("b")) \
        .where("a < b").select("bucket")
    open_ = materialise(rooted.join(mixed, "bucket"), "open")
    low = _rooted(open_.select(F.col("low").alias("doc")).distinct(), roots) \
        .select(F.col("doc").alias("low"), F.col("comp").alias("low_comp"))
    second = open_.join(low, "low").where("comp <> low_comp").select(
        F.col("doc").alias("u"), F.col("low").alias("v")).distinct() \
        .join(first, ["u", "v"], "left_anti")
    more = materialise(_verify(second, sets, threshold), "round2")
    if more.limit(1).count():
        links = links.unionByName(more)
        roots = union_find(links)
    tested = first.unionByName(second)

    rooted = _rooted(open_.drop("comp", "low"), roots)
    mixed = rooted.groupBy("bucket").agg(F.min("comp").alias("a"), F.max("comp").alias("b")) \
        .where("a < b").select("bucket")
    undecided = materialise(rooted.join(mixed, "bucket").select("doc", "n", "comp").distinct(), "undecided")
    third = _prefix_pairs(undecided, sets, threshold).join(tested, ["u", "v"], "left_anti")
    last = materialise(_verify(third, sets, threshold), "round3")
    if last.limit(1).count():
        roots = union_find(links.unionByName(last))

    rep_root = _rooted(classes.withColumnRenamed("rep", "doc"), roots).select("digest", "comp")
    comp = F.when(F.col("doc").isNotNull(), F.coalesce("comp", "doc"))
    return sketch.join(rep_root, "digest", "left").select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), comp.alias("component_id"),
        F.coalesce(comp == F.col("doc"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents without the near-copies: of each group the smallest id
    stays, with all columns of ``docs``; documents without words stay.  Of rows
    that repeat the id and text of a kept document all stay."""
    out = minhash_groups(docs, id_col, text_col, **how).where("not kept").select(
        F.col("doc_id").alias(id_col)).distinct()
    return docs.join(out, id_col, "left_anti")
