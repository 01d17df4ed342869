import random

from hypothesis import given, settings
from hypothesis import strategies as st

from loomkit.llm.fst import Transducer, decode_documents, encode_documents, round_trip
from loomkit.llm.tokens import vocabulary_path
from tests.llm.helpers import docs_frame
from tests.llm.test_packing import PIECE, TEXTS

MACHINE = Transducer(vocabulary_path("piece_bpe_32k.model"))


def test_shortest_paths_equal_the_library():
    r = random.Random(4)
    syll = "the ing er and ou re tion es on st ung keit çé aux ción ñ 12 *** \n ( ) . https:// ab AB".split(" ")
    texts = TEXTS + ["".join(r.choice(syll) + r.choice(["", "", " "]) for _ in range(r.randint(1, 60))) for _ in range(400)]
    got = MACHINE.encode(texts)
    for t, ids in zip(texts, got):
        assert list(ids) == PIECE.whole.encode(t)
        assert MACHINE.decode(ids.tolist()) == PIECE.whole.decode(ids.tolist())


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(codec="utf-8") | st.sampled_from(" \n▁abcdefgeinrst"), max_size=40))
def test_any_text_equals_the_library_and_comes_back(text):
    ids = MACHINE.encode([text])[0].tolist()
    assert ids == PIECE.whole.encode(text)
    if "▁" not in text:
        assert MACHINE.decode(ids) == text


def test_scores_give_the_cheapest_segmentation():
    m = Transducer(vocabulary_path("piece_bpe_32k.model"))
    m.ids, m.score = {"a": 0, "b": 1, "ab": 2, "ba": 3}, {"a": -1.0, "b": -2.0, "ab": -2.5, "ba": -1.1}
    m.trie = {"a": {"": "a", "b": {"": "ab"}}, "b": {"": "b", "a": {"": "ba"}}}
    assert m._by_scores("aba") == ["a", "ba"] and m._by_scores("abab") == ["ab", "ab"] or m._by_scores("abab") == ["a", "ba", "b"]


def test_tables(spark):
    rows = [(1, "Plain words."), (2, None), (3, ""), (4, "ünïcode 日本"), (4, "ünïcode 日本"), (None, "x"), (5, "lo ng " * 30_000)]
    df = docs_frame(spark, rows)
    out = encode_documents(df)
    got = {r.doc_id: r for r in out.collect()}
    assert all(got[i].ids == PIECE.whole.encode(t or "") for i, t in rows) and got[2].n_tokens == 0
    back = {r.doc_id: r.text for r in decode_documents(out).collect()}
    assert back == {i: t or "" for i, t in rows}
    assert round_trip(df).where("decoded_equal").count() == len(rows)
    assert round_trip(docs_frame(spark, [])).count() == 0
