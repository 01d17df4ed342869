import collections
import random
import re

from loomkit.llm.quality import keep_good, quality_rules, repeated_lines, repeated_words, script_of
from tests.llm.helpers import docs_frame


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    win = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if win[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))


def sample():
    r = random.Random(1)
    syll = "the ing er and ou re tion es on st a of in was".split()
    word = lambda: "".join(r.choice(syll) for _ in range(r.randint(1, 3)))
    rows = [(i, " ".join(word() for _ in range(r.randint(30, 200)))) for i in range(150)]
    rows += [(200, "é ü" * 30), (201, ("so it goes on and on again here " * 30)), (202, "a\nb\na\n\n \na b"), (203, None), (204, ""),
             (205, " ".join(f"{r.getrandbits(64):016X}" for _ in range(60))), (206, " x \x1cy " * 15),
             (207, "".join(chr(0x10FFFF - i) + " " for i in range(300))), (208, "x" * 100_000)]
    return rows


def test_base_counts_and_bands(spark):
    rows = sample()
    got = {r.doc_id: r for r in quality_rules(docs_frame(spark, rows)).collect()}
    for d, t in rows:
        r = got[d]
        want = brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)
    assert all(got[i].kept for i in range(150))           # clean documents stay
    assert not got[205].kept and not got[205].base_failed  # hexadecimal: too few characters per token
    assert not got[207].kept and got[207].byte_share > 0.7  # byte fallback


def test_groups_without_language_fall_back_to_scripts(spark):
    rows = [(i, "das ist ein Satz mit genug Wörtern " * 5, None, None) for i in range(3)] + [(9, "слово " * 40, None, None)]
    got = {r.doc_id: r.band_group for r in quality_rules(docs_frame(spark, rows)).collect()}
    assert got == {0: "script:latin", 1: "script:latin", 2: "script:latin", 9: "script:cyrillic"}
    assert script_of("") == script_of("123") == "none"


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, "too short"), (1, "too short"), (None, "short"), (2, " ".join(f"word{i}" for i in range(40)))]
    assert quality_rules(docs_frame(spark, rows)).count() == 4
    assert quality_rules(docs_frame(spark, [])).count() == 0
    assert {r.doc_id for r in keep_good(docs_frame(spark, rows)).collect()} == {None, 2}


def test_windows_and_lines():
    import numpy as np
    assert repeated_words(np.arange(7, dtype=np.uint64)) == 0
    assert repeated_words(np.array([1, 2, 3, 4, 5, 6, 7, 8] * 2, np.uint64)) == 16
    assert repeated_words(np.zeros(9, np.uint64)) == 9
    assert repeated_lines("a\n\na\n b\n b\nb") == 2


def junk(n, seed=5):
    r = random.Random(seed)
    return [" ".join(f"{r.getrandbits(64):016x}" for _ in range(60)) for _ in range(n)]


def clean():
    return [(i, t, "es", f"src{i % 6}") for i, t in sample()[:150]]


def kept_of(spark, rows):
    return {r.doc_id for r in quality_rules(docs_frame(spark, rows)).where("kept").collect()}


def test_a_hot_junk_source_sets_no_band(spark):
    for n in (75, 400):  # a third of the rows, and most of them
        rows = clean() + [(1000 + i, t, "es", "hot") for i, t in enumerate(junk(n))]
        assert kept_of(spark, rows) == set(range(150))


def test_a_hot_group_of_copies_sets_no_band(spark):
    copy, = junk(1)
    rows = clean() + [(1000 + i, copy, "es", f"src{i % 6}") for i in range(400)]
    assert kept_of(spark, rows) == set(range(150))


def test_junk_of_all_sources_and_base_failed_rows_set_no_band(spark):
    rows = clean() + [(1000 + i, t, "es", f"src{i % 6}") for i, t in enumerate(junk(75))]
    rows += [(2000 + i, f"{t.split()[0]} " * 300, "es", f"src{i % 6}") for i, t in enumerate(junk(300, 6))]
    assert kept_of(spark, rows) == set(range(150))
