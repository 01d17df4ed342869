import random

import numpy as np
from pyspark.sql import functions as F

from loomkit.llm import langid as L
from loomkit.llm import queries as Q
from loomkit.llm.common import table
from loomkit.llm.langid import identify, keep_known, page_language, page_text, trigram_codes
from tests.conftest import MEDIUM, SMALL
from tests.llm.helpers import docs_frame

EN = "the thing was there and the others were with them in the morning"
DE = "der Hund und die Katze sind nicht in dem Haus geblieben und schlafen"


def corpus():
    return [(i, EN[i % 7:], "en", "hostA") for i in range(60)] + [(100 + i, DE[i % 7:], "de", "hostB") for i in range(60)]


def test_wrong_declarations_and_priors(spark):
    rows = corpus() + [(300, DE, "en", "hostA"), (301, EN, None, None), (302, "zz", None, "hostB"), (303, "zz", None, "hostA"),
                       (304, None, "en", "hostA"), (305, "", "de", "hostB"), (306, "12 %%", "en", "x"), (307, EN * 2000, "de", "hostB"),
                       (301, EN, None, None), (None, DE, "de", "hostB")]
    out = identify(docs_frame(spark, rows), declared=F.col("lang"), host=F.col("source"))
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(rows)
    assert all(got[i].lang == "en" for i in range(60)) and all(got[100 + i].lang == "de" for i in range(60))
    assert got[300].lang == "de" and got[307].lang == "en"        # the text outweighs a wrong declaration
    assert got[302].lang == "de" and got[303].lang == "en"        # the host decides where the text does not
    assert [got[i].lang for i in (304, 305, 306)] == ["und"] * 3 and not got[304].kept
    kept = {r.doc_id for r in keep_known(docs_frame(spark, rows), declared=F.col("lang"), host=F.col("source")).collect()}
    assert 304 not in kept and 300 in kept and None in kept


def noise(kind, rng):
    letters = {"cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "latin": "abcdefghijklmnopqrstuvwxyz",
               "greek": "αβγδεζηθικλμνξοπρστυφχψω"}[kind]
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(80))


def test_noise_is_not_kept_and_a_small_language_stays(spark):
    rng = random.Random(2)
    docs = table(spark, MEDIUM, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    kinds = ("cyrillic", "latin", "greek")
    rows = [(10 ** 6 + 1000 * j + i, noise(kind, rng), "en" if i % 2 else None, "src1", 0)
            for j, kind in enumerate(kinds) for i in range(100)]
    bulgarian = "всички хора се раждат свободни и равни по достойнство и права те са надарени с разум и съвест".split()
    small = [(2 * 10 ** 6 + i, " ".join(rng.choices(bulgarian, k=60)), "bg", "src2", 0) for i in range(14)]
    both = docs.unionByName(spark.createDataFrame(rows + small, docs.schema))
    got = {r.doc_id: r for r in identify(both, declared=F.col("lang"), host=F.col("source")).collect()}
    for j in range(3):
        assert sum(got[10 ** 6 + 1000 * j + i].kept for i in range(100)) < 2
    assert all(got[r[0]].lang == "bg" and got[r[0]].kept for r in small)
    alone = {r.doc_id: r for r in identify(docs.unionByName(spark.createDataFrame(small[:3], docs.schema)),
                                           declared=F.col("lang"), host=F.col("source")).collect()}
    assert not any(alone[r[0]].kept for r in small[:3])  # too few to be a language, and none of the others
    real = [i for i in got if i < 10 ** 6]
    assert sum(not got[i].kept for i in real) <= 0.02 * len(real)


def test_posteriors_equal_brute_force(spark):
    rows = corpus()[:40] + corpus()[60:100] + [(400, EN[:20] + DE[:30], "de", "hostA"), (401, "zzz qqq xxx " * 9, None, "hostB"),
                                               (402, DE, None, "new"), (403, EN, "fr", "hostA")]
    out = {r.doc_id: r for r in identify(docs_frame(spark, rows), declared=F.col("lang"), host=F.col("source")).collect()}
    langs, k = ["de", "en"], 2
    grams = {r[0]: trigram_codes(r[1]) for r in rows}
    n = np.full((k, L.BUCKETS), 0.5)
    for r in rows:
        if r[2] in langs:
            np.add.at(n[langs.index(r[2])], grams[r[0]], min(1, L.DOC_TRIGRAMS / len(grams[r[0]])))
    logp = np.log(n / n.sum(1, keepdims=True)).astype(np.float32)
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    ll, post = {}, {}
    for r in rows:
        g = grams[r[0]]
        w = L.TEMPER * min(1, L.MAX_TRIGRAMS / len(g))
        ll[r[0]] = np.append(w * logp[:, g].sum(1, dtype=float), -w * len(g) * np.log(L.BUCKETS))
        post[r[0]] = soft(ll[r[0]] + np.log([(1 - L.OTHER) / k] * k + [L.OTHER]))
    said = [r for r in rows if r[2] in langs]
    trust = (sum(post[r[0]][langs.index(r[2])] for r in said) + 9) / (len(said) + 10)
    share = sum(p[:k] for p in post.values()) + 1
    share = share / share.sum()
    smooth = lambda s, p: (s + L.STRENGTH * p) / (s.sum() + L.STRENGTH)
    top = smooth(sum(p[:k] for p in post.values()), share)  # one suffix: none
    for r in rows:
        prior = smooth(sum(post[q[0]][:k] for q in rows if q[3] == r[3]), top)
        say = np.zeros(k + 1)
        if r[2] in langs:
            say = np.append([np.log(trust if x == r[2] else 1 - trust) for x in langs], -np.log(k))
        want = soft(ll[r[0]] + say + np.log(np.append(prior * (1 - L.OTHER), L.OTHER)))
        got = out[r[0]]
        assert np.isclose(got.posterior, want.max()) and got.lang == [*langs, "und"][int(want.argmax())]
        assert got.kept == (want.argmax() < k and want.max() >= 0.6)


def test_empty_tables_and_no_declarations(spark):
    assert identify(docs_frame(spark, []), declared=F.col("lang")).count() == 0
    out = identify(docs_frame(spark, [(1, EN)]), declared=None).collect()
    assert [(r.doc_id, r.lang, r.kept) for r in out] == [(1, "und", False)]


def test_accuracy_on_the_tables(spark):
    for name, least in (("op7_language_id", 0.98), ("language_id_pages", 0.95)):
        out = Q.QUERIES[name](spark, MEDIUM)
        assert out.where("text_lang = declared").count() >= least * out.count()
        assert out.where("not kept").count() <= 0.02 * out.count()


def test_markup_language_and_text(spark):
    html = '<!DOCTYPE html><HTML class="x" lang="de-AT"><script>var no;</script><p>ja &amp; nein</p><!-- weg -->'
    r = spark.createDataFrame([(html,), ("<p>x",), (None,)], "h string").select(
        page_language(F.col("h")).alias("l"), page_text(F.col("h")).alias("t")).collect()
    assert [x.l for x in r] == ["de-AT", None, None] and r[0].t.split() == ["ja", "nein"]


def test_trigrams():
    assert len(trigram_codes(None)) == len(trigram_codes("12 --")) == 0
    assert (trigram_codes("Ab, ab") == trigram_codes("ab  AB")).all()
    assert len(trigram_codes("ab")) == 2 and np.issubdtype(trigram_codes("é").dtype, np.integer)
    assert SMALL
