"""Personal data: fixed patterns against the plain regular expressions, the
field against enumeration of all segmentations, and held-out sentences."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from loomkit.llm import pii as P
from loomkit.llm.common import table
from tests.conftest import SMALL
from tests.llm.helpers import docs_frame

EMPTY = hashlib.sha256(b"").hexdigest()


def plain_base(text):
    """The patterns as they are written, without the faster forms."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


@pytest.fixture(scope="module")
def field():
    return P.trained_field()


def test_base_spans_equal_the_plain_patterns(spark):
    rng = random.Random(1)
    for alphabet in ("a@.-", "1.0 2", "12 -", "+1 ().-", "a1@.+- 0(", "é٣1@a."):
        for _ in range(3000):
            text = "".join(rng.choices(alphabet, k=rng.randint(0, 40)))
            assert P.base_spans(text) == plain_base(text), text
    for r in table(spark, SMALL, "documents").collect():
        assert P.base_spans(r["text"] or "") == plain_base(r["text"] or "")


def test_base_spans_are_linear():
    assert P.base_spans("a" * 400_000 + " " + "1" * 400_000 + " +" + "1(" * 200_000 + "@" * 1000) == []


def segmentations(n, spans):
    def walk(at):
        if at == n:
            yield []
            return
        for rest in walk(at + 1):
            yield [(at, at + 1, 0, 0.0), *rest]
        for i, j, s in spans:
            if i == at:
                for y in range(len(P.KINDS)):
                    for rest in walk(j):
                        yield [(i, j, y + 1, s[y]), *rest]
    yield from walk(0)


def total(path, moves):
    labels = [0, *[p[2] for p in path], 0]
    return sum(p[3] for p in path) + sum(moves[a, b] for a, b in itertools.pairwise(labels))


def test_decoding_and_likelihood_equal_enumeration():
    rng = np.random.default_rng(4)
    for _ in range(25):
        n = 5
        spans = [(int(i), int(j), rng.normal(size=4) * 2) for i, j in
                 {tuple(sorted(rng.choice(n + 1, 2, replace=False))) for _ in range(4)}]
        moves = rng.normal(size=(5, 5))
        moves[0, 0] = 0
        paths = list(segmentations(n, spans))
        scores = np.array([total(p, moves) for p in paths])
        z, marg, pairs = P._forward_backward(n, spans, moves)
        assert np.isclose(z, np.logaddexp.reduce(scores))
        weight = np.exp(scores - z)
        for (i, j, s), m in zip(spans, marg):
            want = [sum(w for w, p in zip(weight, paths) if any(q[:3] == (i, j, y + 1) for q in p)) for y in range(4)]
            assert np.allclose(m, want)
        assert np.isclose(pairs.sum(), sum(w * (len(p) + 1) for w, p in zip(weight, paths)))
        best = P.Field({}, moves).decode(0, n, spans)
        found = {(i, j): s for i, j, s in spans}
        path, at = [], 0
        for i, j, y in best:
            path += [(k, k + 1, 0, 0.0) for k in range(at, i)] + [(i, j, y + 1, found[i, j][y])]
            at = j
        path += [(k, k + 1, 0, 0.0) for k in range(at, n)]
        assert np.isclose(total(path, moves), scores.max())


def test_islands_give_the_best_of_the_whole_text(field):
    rng = random.Random(8)
    for _ in range(60):
        text = " ".join(P.example(rng)[0] for _ in range(2))
        tokens = [m.span() for m in P._TOKEN.finditer(text)]
        spans = [(i, j, field.score(P._features(text, tokens, i, j, f))) for i, j, f in P._spans(text, tokens)]
        whole = [(tokens[i][0], y, tokens[j - 1][1]) for i, j, y in field.decode(0, len(tokens), spans)]
        assert P.field_spans(field, text) == whole


def test_held_out_sentences(field):
    rng, hit, wrong, missed = random.Random(123), 0, 0, 0
    for _ in range(800):
        text, gold = P.example(rng)
        got = set(P.field_spans(field, text))
        hit, wrong, missed = hit + len(got & set(gold)), wrong + len(got - set(gold)), missed + len(set(gold) - got)
    assert hit / (hit + wrong) > 0.97 and hit / (hit + missed) > 0.97


def test_forms_beyond_the_patterns(field):
    def spans(text):
        return [(P.KINDS[y], text[a:b]) for a, y, b, base in P.personal_spans(field, text) if not base]
    assert spans("write to jane.doe [at] mail [dot] com today") == [("email", "jane.doe [at] mail [dot] com")]
    assert spans("ask john dot smith at example dot org about it") == [("email", "john dot smith at example dot org")]
    assert spans("please call (415) 555-2671 before noon") == [("phone", "(415) 555-2671")]
    assert spans("card 4111.1111.1111.1111 was used") == [("card", "4111.1111.1111.1111")]
    assert spans("host fe80:12ab:34cd:56ef:78ab:90cd:12ef:34ab is down") \
        == [("ip", "fe80:12ab:34cd:56ef:78ab:90cd:12ef:34ab")]
    two = "4111111111111111 5500005555555559"
    assert P.base_spans(two) == [] and spans("paid with " + two) == [("card", two[:16]), ("card", two[17:])]


def test_clean_texts_stay_clean(field):
    for text in ("We met at noon. At the end, look at the dot on page 12.", "The year 1999-12-31 23:59:59 and 3.14159",
                 "order 4111111111111112 of 2024, 17,345.20 in total", "isbn 978-3-1614-8410-0, v2.10.3",
                 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15"):
        assert P.personal_spans(field, text) == [], text


def test_mask(field):
    text = "to a.b@c.de, +1 (415) 555-2671 or x [at] y [dot] org."
    assert P.masked(text, P.personal_spans(field, text)) == "to <email>, <phone> or <email>."


def test_awkward_rows(spark):
    long_text = "word " * 100_000 + "a@b.cd " + "7" * 50_000 + " 10.0.0.1"
    rows = [(1, None), (2, ""), (None, "x@y.zz"), (3, "é x@y.zz 1.2.3.4"), (3, "é x@y.zz 1.2.3.4"), (4, long_text)]
    docs = docs_frame(spark, rows).withColumnRenamed("rest", "spans")
    got = sorted(((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"], r["spans"])
                  for r in P.span_digests(P.find_personal_data(docs)).collect()), key=repr)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    both = "email:2:8,ip:9:16"
    tail = f"email:500000:500006,ip:{len(long_text) - 8}:{len(long_text)}"
    assert got == sorted([(1, 0, 0, 0, 0, EMPTY, ""), (2, 0, 0, 0, 0, EMPTY, ""),
                          (None, 1, 0, 0, 0, sha("email:0:6"), "email:0:6"), (3, 1, 1, 0, 0, sha(both), both),
                          (3, 1, 1, 0, 0, sha(both), both), (4, 1, 1, 0, 0, sha(tail), tail)], key=repr)
    assert P.span_digests(P.find_personal_data(docs.limit(0))).count() == 0


def test_query_keeps_every_base_span(spark):
    from loomkit.llm.queries import op11
    texts = {r["doc_id"]: r["text"] for r in table(spark, SMALL, "documents").collect()}
    rows = op11(spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = [f"{P.KINDS[y]}:{a}:{b}" for a, y, b in plain_base(texts[r["doc_id"]] or "")]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in P.KINDS] == [sum(s.startswith(k) for s in base) for k in P.KINDS]
        assert set(base) <= set(r["spans"].split(",")) | {""} and (r["spans"] or not base)
