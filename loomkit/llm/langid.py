"""Language identification by Bayesian evidence fusion.

Evidence on one document, combined as log odds over the languages:

* text: a hashed character-trigram model, counted over all documents by their
  declared language, with a tempered likelihood (trigrams are not independent);
* declared markup language (``lang`` attribute or column), trusted with an
  error rate that is counted: how often the text disagrees with a declaration;
* address suffix and host: prior shares of languages, smoothed hierarchically
  (host towards suffix, suffix towards the corpus), from grouped sums of the
  text posteriors;
* ``other``, the hypothesis that the text is none of the languages: every
  trigram bucket alike, with a small prior.  No language's own text is less
  likely under its model than under that one, but noise and foreign scripts are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomkit.llm.common import materialise, mix64, spread, text_chunks
from loomkit.llm.tokens import release_tables

BUCKETS = 1 << 14
TEMPER = 0.25       # weight of one trigram's log likelihood
MAX_TRIGRAMS = 400  # evidence of a long text counts as that of so many trigrams
STRENGTH = 20.0     # pseudo-counts of the hierarchical smoothing
DOC_TRIGRAMS = 2000  # a longer document's counts are scaled to so many in training
MIN_DOCUMENTS, MIN_TRIGRAMS = 10, 500  # evidence that makes a declared tag a language
OTHER = 0.01        # prior of "none of the languages"
BLOCK = 256         # languages whose model one pass holds (16 MB)


def trigram_codes(text: str | None) -> np.ndarray:
    """Bucket of every character trigram of a text's letters, words fenced by
    blanks; digits and symbols are dropped."""
    if not text:
        return np.empty(0, np.int64)
    u = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    letter = (u >= 97) & (u <= 122) | (u >= 0xC0) & (u != 0xD7) & (u != 0xF7) & ~((u >= 0x2000) & (u < 0x2E80))
    u = np.where(letter, u, np.uint64(32))
    keep = np.ones(len(u), bool)
    keep[1:] = (u[1:] != 32) | (u[:-1] != 32)
    u = np.concatenate([[np.uint64(32)], u[keep], [np.uint64(32)]])
    if len(u) < 3 or (u == 32).all():
        return np.empty(0, np.int64)
    code = mix64((u[:-2] << np.uint64(42)) ^ (u[1:-1] << np.uint64(21)) ^ u[2:])
    return (code % np.uint64(BUCKETS)).astype(np.int64)


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    release_tables()
    total: dict[str, np.ndarray] = {}
    for pdf in text_chunks(batches):
        for text, lang in zip(pdf["text"], pdf["declared"]):
            if lang is not None:
                got = total.setdefault(lang, np.zeros(BUCKETS + 1))  # the last one counts documents
                code = trigram_codes(text)
                got[:BUCKETS] += np.bincount(code, minlength=BUCKETS) * min(1.0, DOC_TRIGRAMS / max(1, len(code)))
                got[BUCKETS] += len(code) > 0
    for lang, n in total.items():
        at = np.flatnonzero(n)
        yield pd.DataFrame({"lang": lang, "bucket": at, "n": n[at]})


def _likelihoods(logp: np.ndarray, more: bool):
    """Adds the weighted log likelihoods under the models ``logp``, and behind the
    last block that of ``other``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release_tables()
        for pdf in text_chunks(batches):
            ll, grams = [], []
            for text, before in zip(pdf["text"], pdf["ll"]):
                code = trigram_codes(text)
                grams.append(len(code))
                weight = TEMPER * min(1.0, MAX_TRIGRAMS / max(1, len(code)))
                now = weight * logp[:, code].sum(axis=1, dtype=np.float64)
                ll.append(np.concatenate([before, now] if more else
                                         [before, now, [-weight * len(code) * np.log(BUCKETS)]]))
            yield pdf.assign(trigrams=grams, ll=ll)
    return run


def train(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_trigrams: int = MIN_TRIGRAMS
          ) -> tuple[list[str], DataFrame]:
    """Languages, and the trigram counts ``(lang, bucket, n)`` of all rows of
    ``(text, declared)`` as a table.

    All trigrams of all rows count; those of a long document weigh less, so that
    one with a wrong declaration cannot make up a language's model.  A declared
    tag is a language from ``min_documents`` documents and ``min_trigrams``
    trigrams on, however large the rest of the table is.
    """
    by = materialise(docs.mapInPandas(_counts, "lang string, bucket int, n double")
                     .groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "trigrams")
    told = by.groupBy("lang").agg(F.sum(F.when(F.col("bucket") == BUCKETS, F.col("n"))).alias("docs"),
                                  F.sum(F.when(F.col("bucket") < BUCKETS, F.col("n"))).alias("grams"))
    langs = [r["lang"] for r in told.where((F.col("docs") >= min_documents) & (F.col("grams") >= min_trigrams))
             .select("lang").orderBy("lang").collect()]
    return langs, by.where(F.col("bucket") < BUCKETS)


def model_of(counts: DataFrame, langs: list[str]) -> np.ndarray:
    """Smoothed log trigram shares of at most ``BLOCK`` languages."""
    rows = counts.where(F.col("lang").isin(langs)).toPandas()
    n = np.full((len(langs), BUCKETS), 0.5)
    at = {x: i for i, x in enumerate(langs)}
    np.add.at(n, (rows["lang"].map(at).to_numpy(np.int64), rows["bucket"].to_numpy(np.int64)), rows["n"].to_numpy())
    return np.log(n / n.sum(axis=1, keepdims=True)).astype(np.float32)


def _softmax(ll: Column) -> Column:
    top = F.transform(ll, lambda x: F.exp(x - F.array_max(ll)))
    return F.transform(top, lambda x: x / F.aggregate(top, F.lit(0.0), lambda a, b: a + b))


def _shares(df: DataFrame, keys: list[str], k: int, name: str) -> DataFrame:
    """Summed posteriors per key as an array column."""
    return df.groupBy(*keys).agg(*[F.sum(F.col("text_post")[i]).alias(f"_{i}") for i in range(k)]) \
        .select(*keys, F.array(*[F.col(f"_{i}") for i in range(k)]).alias(name))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: Column | None = None,
             url: Column | None = None, host: Column | None = None, min_posterior: float = 0.6) -> DataFrame:
    """``(doc_id, lang, posterior, text_lang, declared, kept)`` per document.

    ``declared`` is the markup language, ``url`` an address (its host and host
    suffix are used), ``host`` a host or source given directly.  A document is
    kept if its best language has at least ``min_posterior``.  A text that is
    rather none of the languages is ``und`` and not kept.  Null or letterless
    texts carry no text evidence: language ``und``, not kept.  A null
    declaration, url or host adds none.  Repeated rows are judged each by
    itself; an empty table gives no rows; other columns are ignored.
    """
    none = F.lit(None).cast("string")
    if host is None:
        host = none if url is None else F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]*)", 1))
    suffix = none if url is None else F.regexp_extract(host, r"([^.]*)$", 1)
    tag = none if declared is None else F.regexp_extract(F.lower(F.trim(declared)), r"^[a-z]{2,3}", 0)
    src = spread(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
        F.nullif(tag, F.lit("")).alias("declared"), F.coalesce(host, F.lit("")).alias("host"),
        F.coalesce(suffix, F.lit("")).alias("suffix")))
    langs, counts = train(src.select("text", "declared"))
    k = len(langs)
    if not k:
        return src.select("doc_id", F.lit("und").alias("lang"), F.lit(0.0).alias("posterior"),
                          F.lit("und").alias("text_lang"), "declared", F.lit(False).alias("kept"))
    ll = src.withColumn("trigrams", F.lit(0).cast("long")).withColumn("ll", F.array().cast("array<double>"))
    for i in range(0, k, BLOCK):
        ll = ll.mapInPandas(_likelihoods(model_of(counts, langs[i:i + BLOCK]), i + BLOCK < k), ll.schema)
    seen = materialise(ll.drop("text"), "likelihoods")
    names = F.array(*[F.lit(x) for x in [*langs, "und"]])  # the last one is none of them
    even = F.array(*[F.lit(float(np.log(p))) for p in [(1 - OTHER) / k] * k + [OTHER]])
    post = seen.withColumn("text_post", F.when(F.col("trigrams") > 0, _softmax(
        F.zip_with("ll", even, lambda a, b: a + b))))
    told = post.where("text_post is not null")

    # how far declarations are to be trusted: agreement with the text, smoothed
    agree = F.element_at("text_post", F.array_position(names, F.col("declared")).cast("int"))
    got = told.where(F.col("declared").isin(langs)).agg(F.sum(agree), F.count(F.lit(1))).first()
    trust = ((got[0] or 0.0) + 9.0) / (got[1] + 10.0)
    say = np.log(trust), np.log((1.0 - trust) / max(1, k - 1)) if k > 1 else 0.0

    whole = told.agg(*[F.sum(F.col("text_post")[i]) for i in range(k)]).first()
    share = np.array([whole[i] or 0.0 for i in range(k)]) + 1.0
    share = F.array(*[F.lit(float(x)) for x in share / share.sum()])
    by_suffix = _shares(told, ["suffix"], k, "suffix_sum")
    by_host = _shares(told, ["suffix", "host"], k, "host_sum")

    def smooth(sums: Column, prior: Column) -> Column:
        n = F.aggregate(sums, F.lit(0.0), lambda a, b: a + b)
        return F.zip_with(sums, prior, lambda s, p: (s + F.lit(STRENGTH) * p) / (n + F.lit(STRENGTH)))

    priors = by_host.join(by_suffix, "suffix").select(
        "suffix", "host", smooth(F.col("host_sum"), smooth(F.col("suffix_sum"), share)).alias("prior"))
    said = F.array(*[F.when(F.col("declared").isin(langs), F.when(F.col("declared") == x, float(say[0]))
                            .otherwise(float(say[1]))).otherwise(0.0) for x in langs],
                   F.when(F.col("declared").isin(langs), F.lit(float(-np.log(k)))).otherwise(0.0))
    fused = post.join(priors, ["suffix", "host"], "left").withColumn("fused", _softmax(F.zip_with(
        F.zip_with("ll", said, lambda a, b: a + b), F.concat(
            F.transform(F.coalesce("prior", share), lambda p: p * F.lit(1 - OTHER)), F.array(F.lit(OTHER))),
        lambda a, p: a + F.log(p))))

    def best(p: str) -> Column:
        return F.element_at(names, F.array_position(F.col(p), F.array_max(p)).cast("int"))

    has = F.col("trigrams") > 0
    told_one = F.array_position("fused", F.array_max("fused")) <= k
    top = F.when(has, F.array_max("fused")).otherwise(0.0)
    return fused.select(
        "doc_id", F.when(has, best("fused")).otherwise("und").alias("lang"), top.alias("posterior"),
        F.when(has, best("text_post")).otherwise("und").alias("text_lang"), "declared",
        (has & told_one & (top >= min_posterior)).alias("kept"))


def page_language(html: Column) -> Column:
    """The ``lang`` attribute of a page's ``html`` element (null: none)."""
    return F.nullif(F.regexp_extract(html, r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-zA-Z-]+)", 1), F.lit(""))


def page_text(html: Column) -> Column:
    """A page without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(bare, r"<[^>]*>|&[a-zA-Z0-9#]+;", " ")


def keep_known(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """``docs`` without the documents whose language is not told, all columns
    kept.  Rows that repeat an id go if any of them is rejected; a null id stays."""
    out = identify(docs, id_col, **how).where("not kept").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(out, id_col, "left_anti")
