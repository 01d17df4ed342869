import os
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loomkit.llm.packing import pack_documents, sequences
from loomkit.llm.tokens import PieceBpe, WordBpe, vocabulary_path
from tests.llm.helpers import docs_frame

os.environ["TOKENIZERS_PARALLELISM"] = "false"
WORD, PIECE = WordBpe(vocabulary_path("word_bpe_49k.json")), PieceBpe(vocabulary_path("piece_bpe_32k.model"))
TEXTS = ["", " ", "Plain words, and don't 123 stop.", "ΣΑΣ Σ İstanbul ẞ", "a<|endoftext|>b <|x", "é é  x y　z",
         "tab\tline\r\n\x0b\x0c\x1c\x1d\x85end", "日本語 ไทย हिन्दी", "emoji 👩‍👩‍👧 \U0001f600", "x" * 5000, "▁ ▁▁ mark", "﻿bom ​zero",
         "  lead", "trail  ", "a  b   c", "0٣½Ⅷ"]


def test_cached_ids_equal_the_tokenizer():
    whole = [list(x) for x in WORD.encode(TEXTS)]
    assert whole == [WORD.whole.encode(t, add_special_tokens=False).ids for t in TEXTS]
    assert [list(x) for x in PIECE.encode(TEXTS)] == [PIECE.whole.encode(t) for t in TEXTS]


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(codec="utf-8", max_codepoint=0x2FFF) | st.sampled_from(" \n'’sSτTİσΣ"), max_size=60))
def test_cached_ids_equal_the_tokenizer_on_any_text(text):
    assert list(WORD.encode([text])[0]) == WORD.whole.encode(text, add_special_tokens=False).ids
    assert list(PIECE.encode([text])[0]) == PIECE.whole.encode(text)


def test_a_full_word_table_starts_over():
    coder = PieceBpe(vocabulary_path("piece_bpe_32k.model"))
    coder.table.max_words = 3
    for t in ["a b c d e f", "b c", "z y x w a"]:
        assert list(coder.encode([t])[0]) == coder.whole.encode(t)


def test_pieces_cover_every_id_once(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice("der one two pack ßü 9").strip() or "x" for _ in range(r.choice([0, 1, 5, 300, 5000]))))
            for i in range(60)] + [(900, None), (901, ""), (902, "twice"), (902, "twice"), (None, "no id")]
    out = pack_documents(docs_frame(spark, rows), window=256).toPandas()
    want = sorted((-1 if d is None else d, len(x) + 1) for d, t in rows
                  for x in [WORD.whole.encode(t or "", add_special_tokens=False).ids])
    pos = out.sort_values(["sequence_id", "offset"])
    at = (pos.sequence_id * 256 + pos.offset).to_numpy()
    assert at[0] == 0 and (at[1:] == at[:-1] + pos.length.to_numpy()[:-1]).all()
    assert at[-1] + pos.length.iloc[-1] == sum(n for _, n in want)
    assert (out.offset + out.length <= 256).all()
    for d, t in rows[:61]:
        ids = np.array(WORD.whole.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        mine = out[out.doc_id == d].sort_values("start")
        assert mine.length.sum() == len(ids) and (mine.doc_tokens == len(ids)).all()
        for p in mine.itertuples():
            assert p.ids_crc32 == zlib.crc32(ids[p.start:p.start + p.length].tobytes())
    assert len(out[out.doc_id == 902]) >= 2 and out.doc_id.isna().any()


def test_sequences_are_padded_unless_a_power_of_two(spark):
    pieces = pack_documents(docs_frame(spark, [(1, "a " * 300)]), window=128)
    got = {r.sequence_id: r for r in sequences(pieces, 128, pad_id=9).collect()}
    assert [got[i].n_tokens for i in range(3)] == [128, 128, 45]
    assert len(got[2].ids) == 128 and set(got[2].ids[45:]) == {9}
    four = sequences(pack_documents(docs_frame(spark, [(1, "a a a")]), window=128), 128).first()
    assert len(four.ids) == four.n_tokens == 4


def test_empty_table(spark):
    assert pack_documents(docs_frame(spark, [])).count() == 0
