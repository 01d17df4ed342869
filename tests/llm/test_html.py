import difflib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomkit.llm.html_extract import decode, extract_main_text, forest, log_odds, training_page
from loomkit.llm.html_nodes import Node, features, nodes_of, parse

SCHEMA = "page_id long, url string, html string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("text", "n_chars", "label")})


def wanted(marked: str) -> str:
    """Text of the marked blocks of a training page."""
    blocks = []
    for node in nodes_of(parse(marked)):
        if node.parts is not None and node.text:
            at = node if node.tag != "#text" else node.parent
            if "yyy" in at.attrs and at.tag not in ("div", "section", "article", "main", "ul", "table", "tr"):
                blocks.append(node.text)
    return "\n\n".join(blocks)


def test_held_out_pages(spark):
    seeds = range(50, 200)  # none of them is a training seed
    marked = {i: training_page(i) for i in seeds}
    rows = [(i, "u", m.replace(' data-label="yyy"', "")) for i, m in marked.items()]
    got = {r.page_id: r.text for r in extract_main_text(frame(spark, rows)).collect()}
    hit = kept = real = 0
    for i, m in marked.items():
        a, b = wanted(m).split(), got[i].split()
        same = sum(x.size for x in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
        hit, kept, real = hit + same, kept + len(b), real + len(a)
    assert hit / kept > 0.95 and hit / real > 0.95, (hit / kept, hit / real)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><div class="ad">Buy things now, cheap.</div>
<article><h1>A head &amp; more</h1><p><b>First  paragraph of&nbsp;the text, with
 a line break.<br><p>Second &lt;one&gt; says some more words, enough of them.</p><p>Third ends the article, in a sentence.</p></article>
<section class="comments"><h3>Comments</h3><div class="comment"><p>I do not agree with this article at all.</p></div></section>
<footer>&copy; someone &middot; all the rest.</footer></body></html>"""
TEXT = "A head & more\n\nFirst paragraph of the text, with a line break.\n\nSecond <one> says some more words, enough of them.\n\n" \
       "Third ends the article, in a sentence."


def test_page_and_awkward_rows(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p"), (None, "u", PAGE), (5, "u", "<div>" * 3000 + "x"),
            (6, "u", "</p></div></body>"), (7, "u", PAGE.replace("Third", "Third " + "long words follow. " * 20_000))]
    out = extract_main_text(frame(spark, rows)).collect()
    got = {r.page_id: r for r in out}
    assert len(out) == len(rows) and got[1].text == got[None].text == TEXT and got[1].n_chars == len(TEXT)
    assert got[2].text == got[3].text == got[6].text == "" and got[2].url is None and len(got[7].text) > 380_000
    assert extract_main_text(frame(spark, [])).count() == 0


def test_trees_score_as_the_fitted_model(spark):
    x = np.concatenate([features(nodes_of(parse(training_page(i).replace("yyy", "")))) for i in range(40)])
    odds = log_odds(forest(spark), x)
    assert odds.shape == (len(x),) and (odds > 0).any() and (odds < 0).any()


@pytest.mark.parametrize("seed", range(6))
def test_decoding_is_the_best_consistent_labelling(seed):
    r = np.random.default_rng(seed)
    order = [Node("div", "", None)]
    for i in range(1, 9):
        up = order[r.integers(0, i)]
        order.append(Node("div", "", up))
        up.children.append(order[-1])
    for i, n in enumerate(order):
        n.order, n.text, n.size = i, f"t{i}", 1
    odds = r.normal(size=len(order))
    best = max((sum(odds[i] for i in range(1, 9) if m >> i & 1), m) for m in range(1, 1 << 9, 2)
               if all(m >> order[i].parent.order & 1 for i in range(1, 9) if m >> i & 1))
    assert decode(order, odds) == [f"t{i}" for i in range(9) if best[1] >> i & 1]


def test_unclosed_and_nested_markup():
    order = nodes_of(parse("<p>a<p>b<ul><li>c<li>d</ul><table><tr><td>e<td>f</table>g<script>h</script>i"))
    assert [n.text for n in order if n.text] == ["a", "b", "c", "d", "e", "f", "g i"] or \
        [re.sub(" ", "", n.text) for n in order if n.text][-1] == "gi"
