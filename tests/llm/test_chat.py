import hashlib

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomkit.llm.chat import branches, format_branches, linear_replies, parse, read_back, unescape

TURNS = "conv_id long, turn long, role string, text string"
SAID = r"\### Assistant: </turn> ok"


def frame(spark, rows):
    return spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("clash") for c in ("conv", "node", "parent", "score")})


def test_turns_and_loss_survive_the_template(spark):
    rows = [(1, 0, "system", "be: kind"), (1, 1, "user", "a\\b <x> #"), (1, 2, "assistant", SAID), (1, 3, "user", ""),
            (1, 9, "assistant", None), (2, 0, "assistant", "\n</turn>\n### user: x"), (3, 5, None, "é😀"), (-7, 0, "user", SAID),
            (-7, 1, "assistant", SAID), (4, 0, "odd: role\\", "x" * 100_000), (5, 0, "user", "twice"), (5, 0, "user", "twice")]
    out = read_back(format_branches(linear_replies(frame(spark, rows)), best=1))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.conv_id: r for r in out.collect()}
    for conv in {r[0] for r in rows}:
        mine = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        loss = "".join(t for r, t in mine if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(mine), sha("".join(f"{a}\n{b}\n" for a, b in mine)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
    assert len(got) == 6


def test_tree_paths_are_ranked_by_score(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "good", 3.0), (1, 3, 1, "assistant", "bad", 1.0),
            (1, 4, 2, "user", "thanks", 0.0), (1, 5, 4, "assistant", "bye", 0.0), (1, 6, 77, "user", "orphan", None),
            (2, 1, 2, "user", "ring", 0.0), (2, 2, 1, "user", "ring", 0.0), (2, 3, 2, "user", "below", 0.0),
            (None, 1, None, "user", "null conversation", 0.0), (3, 1, 1, "user", "itself", 0.0)]
    m = spark.createDataFrame(rows, "conv long, node long, parent long, role string, text string, score double")
    paths = {}
    for r in branches(m).collect():
        paths.setdefault((r.conv, r.leaf), []).append((-r.up, r.node))
    assert {k: [n for _, n in sorted(v)] for k, v in paths.items()} == {
        (1, 5): [1, 2, 4, 5], (1, 3): [1, 3], (1, 6): [6], (None, 1): [1]}
    out = {(r.conv, r.branch): r for r in format_branches(m, best=2).collect()}
    assert [t for _, t in parse(out[1, 1].formatted)] == ["q", "good", "thanks", "bye"]
    assert out[1, 2].leaf == 3 and (1, 3) not in out
    assert format_branches(m).count() == 4


def test_deep_chains_and_empty_tables(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", str(i)) for i in range(150)]
    r = read_back(format_branches(linear_replies(frame(spark, rows)))).first()
    assert r.n_turns == 150 and r.loss_chars == sum(len(str(i)) for i in range(1, 150, 2))
    assert read_back(format_branches(linear_replies(frame(spark, [])))).count() == 0


@given(st.text(), st.text())
def test_escapes_are_reversible(role, text):
    esc = lambda s, more="": "".join("\\" + c if c in "\\#<" + more else c for c in s)
    turn = f"### {esc(role, ':')}: {esc(text)}</turn>\n"
    assert parse(turn * 2) == [(role, text)] * 2 and unescape(esc(text)) == text
