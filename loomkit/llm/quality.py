"""Quality rules by tokeniser fertility.

One pass over the whole text gives the base counts (words, symbols, repeated
lines and windows) and what a public vocabulary makes of the text: characters
per token, share of byte-fallback tokens, and entropy of the token
distribution.  Grouped statistics over the distinct texts of a language (or
script, where none is declared) that pass the base rules, with a bounded weight
of every source, give the bands outside which a document is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomkit.llm.common import materialise, spread, text_chunks, windows64, words_of
from loomkit.llm.tokens import piece_bpe, vocabulary_path

# Fixed values of the base rules.
SYMBOLS = re.compile(r"[#*$%&|<>]")
MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
CEILING_TOKENS = 512
BIN = 1000  # band statistics: bins of 1/1000 (characters per token: of 1/1000 of the value)
BROADCAST_GROUPS = 4096  # band tables up to so many rows are broadcast, longer ones joined

# Scripts told apart where no language is declared (fixed values: block ranges).
SCRIPTS = {
    "latin": "A-Za-zÀ-ɏ", "greek": "Ͱ-Ͽ", "cyrillic": "Ѐ-ԯ",
    "hebrew": "֐-׿", "arabic": "؀-ۿ", "devanagari": "ऀ-ॿ",
    "thai": "฀-๿", "kana": "぀-ヿ", "han": "一-鿿",
    "hangul": "가-힯",
}
_SCRIPT_RE = {name: re.compile(f"[{chars}]") for name, chars in SCRIPTS.items()}


def repeated_words(codes: np.ndarray, width: int = REPEAT_WINDOW) -> int:
    """Words that lie in a ``width``-word window found twice or more."""
    win = windows64(codes, width)
    if len(win) < 2:
        return 0
    _, back, count = np.unique(win, return_inverse=True, return_counts=True)
    again = count[back] > 1
    if not again.any():
        return 0
    cover = np.zeros(len(codes) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def script_of(text: str) -> str:
    """The script of most letters of a text, ``none`` without letters."""
    if text.isascii():
        return "latin" if _SCRIPT_RE["latin"].search(text) else "none"
    counts = {k: len(r.findall(text)) for k, r in _SCRIPT_RE.items()}
    best = max(counts, key=counts.get)
    return best if counts[best] else "none"


def _entropy(ids: np.ndarray) -> float:
    if not len(ids):
        return 0.0
    p = np.unique(ids, return_counts=True)[1] / len(ids)
    return float(max(0.0, -(p * np.log2(p)).sum()))


def _measures(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = piece_bpe(path)
        for pdf in text_chunks(batches):
            texts = [t or "" for t in pdf["text"]]
            out = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                   "n_tokens", "n_chars", "byte_tokens", "entropy", "script", "digest")}
            for t, lang, ids in zip(texts, pdf["lang"], coder.encode(texts)):
                words = words_of(t)
                codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
                joined = b"".join(words)
                chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "surrogatepass"))
                out["n_words"].append(len(words))
                out["word_chars"].append(chars)
                out["n_symbols"].append(len(SYMBOLS.findall(t)))
                out["n_dup_lines"].append(repeated_lines(t))
                out["n_repeat_words"].append(repeated_words(codes))
                out["n_tokens"].append(len(ids))
                out["n_chars"].append(len(t))
                out["byte_tokens"].append(int(coder.is_byte[ids].sum()))
                out["entropy"].append(_entropy(ids))
                out["script"].append(script_of(t) if lang is None else None)
                out["digest"].append(xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang": pdf["lang"], "source": pdf["source"], **out})
    return run


_SCHEMA = ("doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
           "n_repeat_words long, n_tokens long, n_chars long, byte_tokens long, entropy double, script string, digest binary")


def measure(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
            lang_col: str | None = "lang", source_col: str | None = "source") -> DataFrame:
    """Base counts and token measures of every document (null text: empty)."""
    def given(c: str | None) -> Column:
        return F.col(c).cast("string") if c and c in docs.columns else F.lit(None).cast("string")

    src = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                             given(lang_col).alias("lang"), F.coalesce(given(source_col), F.lit("")).alias("source")))
    m = src.mapInPandas(_measures(path or vocabulary_path("piece_bpe_32k.model")), _SCHEMA)
    return m.select(
        "*", ((F.col("n_words") < MIN_WORDS) | (
            100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
        F.coalesce("lang", F.concat(F.lit("script:"), "script")).alias("band_group"),
        F.try_divide(F.col("n_chars"), F.col("n_tokens")).alias("chars_per_token"),
        F.try_divide(F.col("byte_tokens"), F.col("n_tokens")).alias("byte_share"),
        # entropy against the ceiling of a text of this length; the vocabulary of a
        # longer one no longer grows with it
        F.when(F.col("n_tokens") > 1, F.col("entropy") / F.log2(F.least("n_tokens", F.lit(CEILING_TOKENS))))
        .alias("rel_entropy"))


def _small(df: DataFrame, tag: str) -> DataFrame:
    """A written table, broadcast where it is short."""
    df = materialise(df, tag)
    return F.broadcast(df) if df.count() <= BROADCAST_GROUPS else df


def fertility_bands(measures: DataFrame, spread_factor: float = 4.0, floor: float = 0.10,
                    min_tokens: int = 50) -> DataFrame:
    """Rejection bands per language or script, from the documents of the group
    that pass the base rules and have at least ``min_tokens`` tokens.

    A text counts once however often it is copied (for its smallest source).  A
    source counts with all of its texts up to the median source of the group
    (the upper one of an even number) and as much as that one beyond: of S
    sources none has more than 2 / S of the weight.  Rows without a source are
    one source.

    With the weighted median and the weighted median absolute deviation (MAD;
    twice that is the quartile distance of a symmetric measure) the bands are:
    characters per token: median -+ max(``spread_factor`` x 2 MAD, ``floor`` x
    the median); ``quality_rules`` widens this for short texts by sqrt(1 + 100 /
    tokens).  Byte share: above median + MAD by the same rule with a floor of
    0.3.  Relative entropy: below median - MAD by the same rule with a floor of
    0.15.  Both come from histograms with bins of 1 / ``BIN`` (of the value, for
    characters per token), so no group is gathered.
    """
    names = ("chars_per_token", "byte_share", "rel_entropy")
    texts = measures.where(~F.col("base_failed") & (F.col("n_tokens") >= min_tokens)) \
        .groupBy("band_group", "digest").agg(F.min("source").alias("source"), *[F.min(c).alias(c) for c in names])
    binned = [F.round((F.log(c) if c == names[0] else F.col(c)) * BIN).cast("int") for c in names]
    bins = materialise(texts.select("band_group", "source", F.explode(F.array(*[
        F.struct(F.lit(c).alias("measure"), b.alias("bin")) for c, b in zip(names, binned)])).alias("b"))
        .groupBy("band_group", "source", "b.measure", "b.bin").agg(F.count(F.lit(1)).alias("n"))
        .where("bin is not null"), "bins")
    sizes = bins.where(F.col("measure") == names[0]).groupBy("band_group", "source").agg(F.sum("n").alias("size"))
    most = _small(sizes.groupBy("band_group").agg((-F.percentile_approx(-F.col("size"), 0.5, 1000)).alias("most")), "most")
    weight = sizes.join(most, "band_group").select(
        "band_group", "source", F.least(F.lit(1.0), F.col("most") / F.col("size")).alias("weight"))
    # whole millionths, so that the order of summing changes nothing
    hist = bins.join(weight, ["band_group", "source"]).groupBy("band_group", "measure", "bin") \
        .agg(F.sum(F.round(F.col("n") * F.col("weight") * 1e6).cast("long")).alias("w"))
    by = Window.partitionBy("band_group", "measure")  # rows: the bins of one measure

    def with_middle(df: DataFrame, x: str, out: str) -> DataFrame:
        df = df.withColumn("upto", F.sum("w").over(by.orderBy(x))).withColumn("whole", F.sum("w").over(by))
        return df.withColumn(out, F.min(F.when(2 * F.col("upto") >= F.col("whole"), F.col(x))).over(by))

    x = F.col("bin") / BIN
    hist = with_middle(hist.withColumn("x", F.when(F.col("measure") == names[0], F.exp(x)).otherwise(x)), "x", "mid")
    hist = with_middle(hist.withColumn("off", F.abs(F.col("x") - F.col("mid"))), "off", "mad")
    q = hist.groupBy("band_group").agg(*[F.max(F.when(F.col("measure") == c, F.struct("mid", "mad"))).alias(c)
                                         for c in names])

    def reach(c: str, least) -> Column:
        return F.greatest(F.lit(2 * spread_factor) * F.col(c)["mad"], least)

    cpt, byt, ent = names
    return q.select(
        "band_group", F.col(cpt)["mid"].alias("mid_chars_per_token"),
        reach(cpt, F.lit(floor) * F.col(cpt)["mid"]).alias("reach_chars_per_token"),
        (F.col(byt)["mid"] + F.col(byt)["mad"] + reach(byt, F.lit(0.3))).alias("max_byte_share"),
        (F.col(ent)["mid"] - F.col(ent)["mad"] - reach(ent, F.lit(0.15))).alias("min_rel_entropy"))


def quality_rules(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                  lang_col: str | None = "lang", source_col: str | None = "source", **bands) -> DataFrame:
    """Verdict of every document: base counts, token measures and ``kept``.

    ``base_failed``: under 20 words, or repeated 8-word windows cover more than
    30 % of the words.  Else the document is kept if its measures lie inside
    the bands of its language (script where the language is null).  Documents
    below the bands' ``min_tokens``, and groups without bands, are judged by
    the base rules alone.  Null and empty texts have no words and fail; repeated
    rows are judged each by itself; an empty table gives no rows; other columns
    of ``docs`` are ignored.
    """
    m = materialise(measure(docs, path, id_col, text_col, lang_col, source_col), "measures")
    band = _small(fertility_bands(m, **bands), "bands")
    short = F.col("n_tokens") < bands.get("min_tokens", 50)
    wide = F.col("reach_chars_per_token") * F.sqrt(1 + 100 / F.col("n_tokens"))
    inside = ((F.abs(F.col("chars_per_token") - F.col("mid_chars_per_token")) <= wide)
              & (F.col("byte_share") <= F.col("max_byte_share"))
              & (F.col("rel_entropy") >= F.col("min_rel_entropy")))
    return m.join(band, "band_group", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (short | F.coalesce(inside, F.lit(True)))).alias("kept"),
        "n_tokens", "chars_per_token", "byte_share", "entropy", "rel_entropy", "band_group")


def keep_good(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """``docs`` without the documents that the rules reject, all columns kept.
    Rows that repeat an id go if any of them is rejected; a null id stays."""
    out = quality_rules(docs, id_col=id_col, **how).where("not kept").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(out, id_col, "left_anti")
