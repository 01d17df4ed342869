"""Main text of pages: boosted trees over DOM nodes, decoded down the tree.

A gradient-boosted classifier (Spark ML) judges every node: does its subtree
hold main text?  Decoding picks the labelling of the whole tree with the
highest total log odds in which no kept node lies below a dropped one; dropping
a node drops everything in it, so ancestors and descendants cannot disagree.

The classifier is fitted on ``TRAIN_PAGES`` labelled pages (a documented
bound) that ``training_page`` lays out at random: semantic or class-named
containers, or bare ones, around articles, menus, headers, footers, sidebars,
notices, adverts, forms and reader comments.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkit.llm.common import spread, text_chunks
from loomkit.llm.html_nodes import FEATURES, Node, features, nodes_of, parse

TRAIN_PAGES, TREES, DEPTH, SEED = 600, 20, 5, 11


def _word(r: random.Random) -> str:
    return "".join(r.choice("bcdfghklmnprstvwzß") + r.choice("aeiouéäó") for _ in range(r.randint(1, 4)))


def _words(r: random.Random, lo: int, hi: int) -> str:
    return " ".join(_word(r) for _ in range(r.randint(lo, hi)))


def _prose(r: random.Random, lo: int, hi: int) -> str:
    """Sentences, now and then with odd symbols, a link or an unclosed tag."""
    junk = r.random() < 0.1
    out = []
    for _ in range(r.randint(lo, hi)):
        s = _words(r, 1, 16).capitalize()
        if junk:
            s = s.replace(" ", r.choice(["*** ", "&amp;&amp; ", "%% "]))
        if r.random() < 0.1:
            s = f'<a href="/{_word(r)}">{s}</a>'
        out.append(s + r.choice("...!?"))
    text = " ".join(out)
    if r.random() < 0.15:
        return f"<b>{text}<br>"
    return f"<em>{text}</em>" if r.random() < 0.05 else text


def _links(r: random.Random, n: int) -> str:
    one = lambda: f'<a href="/{_word(r)}">{_words(r, 1, 3)}</a>'
    if r.random() < 0.7:
        return "<ul>" + "".join(f"<li>{one()}</li>" for _ in range(n)) + "</ul>"
    return r.choice([" | ", " ", "<br>"]).join(one() for _ in range(n))


def _box(r: random.Random, tags: str, words: str, inner: str, main: bool = False, plain: float = 0.1) -> str:
    """A container by a semantic tag, by a telling class or id, or by neither."""
    tag = r.choice(tags.split())
    how = r.random()
    attr = ""
    if how >= plain and (tag in ("div", "section", "p", "ul") or r.random() < 0.5):
        word = r.choice(words.split())
        word = r.choice([word, word, f"{word}-{_word(r)}", f"{_word(r)} {word}", f"{_word(r)}_{word}"])
        attr = f' {r.choice(["class", "class", "id"])}="{word}"'
    mark = ' data-label="yyy"' if main else ""
    return f"<{tag}{attr}{mark}>{inner}</{tag}>"


def _article(r: random.Random) -> list[str]:
    """Blocks of an article, each marked as main text."""
    y = ' data-label="yyy"'
    blocks = [f"<h1{y}>{_words(r, 2, 10)}</h1>"] if r.random() < 0.85 else []
    for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14])):
        kind = r.random()
        if kind < 0.78:
            blocks.append(f"<p{y}>{_prose(r, 1, 9)}" + ("</p>" if r.random() < 0.9 else ""))
        elif kind < 0.86:
            blocks.append(f"<h{(n := r.randint(2, 4))}{y}>{_words(r, 1, 7)}</h{n}>")
        elif kind < 0.91:
            blocks.append(f"<ul{y}>" + "".join(f"<li{y}>{_prose(r, 1, 2)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
        elif kind < 0.95:
            blocks.append(f"<blockquote{y}>{_prose(r, 1, 3)}</blockquote>")
        elif kind < 0.97:
            blocks.append(f"<table{y}>" + "".join(
                f"<tr{y}>" + "".join(f"<td{y}>{_words(r, 1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>")
        else:
            blocks.append(f"<pre{y}>{_words(r, 5, 40)}</pre>")
    return blocks


def training_page(seed: int) -> str:
    """A random page; elements with main text carry ``data-label="yyy"``."""
    r = random.Random(seed)
    box = lambda *a, **k: _box(r, *a, **k)
    ad = lambda: box("div div aside section p", "ad ads advert advertisement promo sponsor sponsored",
                     r.choice([_prose(r, 1, 3), _words(r, 2, 9), _links(r, 2)]), plain=0.0)
    share = lambda: box("div ul p", "share social tags meta byline tools", _links(r, r.randint(2, 5)))
    notice = lambda: box("div section p dialog aside", "notice cookie consent alert newsletter subscribe popup",
                         _prose(r, 1, 3), plain=0.0)
    form = lambda: f"<form{r.choice(['', ' class=search', ' id=login'])}><p>{_words(r, 1, 6)}</p>" \
        f"<label>{_words(r, 1, 3)}</label><input><button>{_word(r)}</button></form>"  # noqa: E731
    nav = lambda: box("nav nav div ul", "nav menu breadcrumb navbar pagination", _links(r, r.randint(3, 9)))
    body = _article(r)
    for extra in (ad, share, notice, form):
        if r.random() < 0.25:
            body.insert(r.randint(0, len(body)), extra())
    inner = "".join(body)
    if r.random() < 0.4:
        inner = box("div section", "content body entry text post story", inner, main=True, plain=0.4)
    top = f"<p>{_words(r, 1, 5)}</p>" if r.random() < 0.5 else ""
    main = box("article article article main div div section", "article content main post story entry prose", top * (r.random() < 0.1) + inner,
               main=True, plain=0.3)
    comment = lambda: box("div li article section", "comment reply comment-body", "".join(
        [f"<p>{_words(r, 1, 3)}</p>" * (r.random() < 0.6), f"<p>{_prose(r, 1, 6)}</p>", _links(r, 1) * (r.random() < 0.5)]), plain=0.3)
    comments = box("section div ol aside", "comments discussion responses replies disqus thread",
                   (f"<h{(n := r.randint(2, 4))}>{_words(r, 1, 4)}</h{n}>" if r.random() < 0.7 else "")
                   + "".join(comment() for _ in range(r.randint(1, 7))), plain=0.0)
    teaser = lambda: f"<h3>{_words(r, 2, 6)}</h3><p>{_prose(r, 1, 2)}</p>"
    side = box("aside aside div section", "sidebar aside widget related recommended popular rail",
               "".join(r.choice([teaser, lambda: _links(r, 4), ad, lambda: f"<p>{_prose(r, 1, 4)}</p>"])()
                       for _ in range(r.randint(1, 4))), plain=0.05)
    head = box("header header div", "header masthead banner logo topbar",
               r.choice([f"<h1>{_words(r, 1, 3)}</h1>", f"<p>{_prose(r, 1, 1)}</p>", _words(r, 1, 4)]) + nav() * (r.random() < 0.5),
               plain=0.0)
    foot = box("footer footer footer div", "footer colophon copyright legal imprint",
               r.choice([f"&copy; {_word(r)} &middot; ", ""]) + r.choice([_prose(r, 1, 3), f"<p>{_prose(r, 1, 3)}</p>", _links(r, 5)]),
               plain=0.0)
    if r.random() < 0.35:
        main = main + comments if r.random() < 0.6 else main[:main.rindex("</")] + comments + main[main.rindex("</"):]
    if r.random() < 0.4:
        main = main + side if r.random() < 0.6 else side + main
    if r.random() < 0.25:
        main = box("div main section", "container wrapper page layout", main, main=True, plain=0.5)
    before = [x() for x, p in ((nav, 0.8), (ad, 0.45), (notice, 0.3), (form, 0.2)) if r.random() < p]
    r.shuffle(before)
    after = [x() for x, p in ((ad, 0.2), (notice, 0.2), (form, 0.15), (nav, 0.15)) if r.random() < p]
    page = ([head] if r.random() < 0.5 else []) + before + [main] + after + ([foot] if r.random() < 0.85 else [])
    return (f"<!DOCTYPE html><html><head><title>{_words(r, 2, 8)}</title><script>var t='</p>';</script></head><body>"
            + "".join(page) + ("</body></html>" if r.random() < 0.8 else ""))


def labelled_nodes(html: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a marked page: 1 for nodes that hold main text."""
    root = parse(html)
    stack: list[Node] = [root]
    while stack:  # marks are read and taken away before features see them
        node = stack.pop()
        node.label = "yyy" in node.attrs
        node.attrs = node.attrs.replace("yyy", "")
        stack.extend(node.children)
    order = nodes_of(root)
    y = np.zeros(len(order))
    for node in order:
        leaf_main = node.label and node.parts is not None or (
            node.tag == "#text" and node.parent is not None and node.parent.label and node.parent.tag in ("p", "li", "blockquote", "td", "pre"))
        if leaf_main and node.text:
            up = node
            while up is not None and not y[up.order]:
                y[up.order] = 1
                up = up.parent
    return features(order), y


def _sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for seed in pdf["id"]:
            x, y = labelled_nodes(training_page(int(seed)))
            yield pd.DataFrame({"x": list(x.astype(float)), "label": y})


def train_forest(spark: SparkSession, pages: int = TRAIN_PAGES, trees: int = TREES, depth: int = DEPTH) -> list[tuple]:
    """Boosted trees over the nodes of ``pages`` training pages, as arrays
    ``(feature, threshold, left, right, value)`` with the tree weight in the values."""
    rows = spark.range(SEED * 100_000, SEED * 100_000 + pages, 1, 4).mapInPandas(
        _sample, "x array<double>, label double")
    data = rows.select(array_to_vector("x").alias("features"), "label").persist()
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=SEED, maxBins=32).fit(data)
    data.unpersist()
    out = []
    for tree, weight in zip(model.trees, model.treeWeights):
        flat: list[list] = []

        def add(node, weight=weight, flat=flat) -> int:
            at = len(flat)
            flat.append([-1, 0.0, at, at, 0.0])
            if node.subtreeDepth() == 0:
                flat[at][4] = weight * node.prediction()
            else:
                flat[at][:2] = [node.split().featureIndex(), node.split().threshold()]
                flat[at][2] = add(node.leftChild())
                flat[at][3] = add(node.rightChild())
            return at

        add(tree._call_java("rootNode"))
        f, t, a, b, v = zip(*flat)
        out.append((np.array(f), np.array(t), np.array(a), np.array(b), np.array(v)))
    return out


_FORESTS: dict[str, list[tuple]] = {}


def forest(spark: SparkSession) -> list[tuple]:
    """The classifier, fitted once per application."""
    key = spark.sparkContext.applicationId
    if key not in _FORESTS:
        _FORESTS[key] = train_forest(spark)
    return _FORESTS[key]


def log_odds(trees: list[tuple], x: np.ndarray) -> np.ndarray:
    """Log odds of main text for every row of features."""
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for f, t, a, b, v in trees:
        at = np.zeros(len(x), np.int64)
        while (inner := f[at] >= 0).any():
            go = x[rows, np.maximum(f[at], 0)] <= t[at]
            at = np.where(inner, np.where(go, a[at], b[at]), at)
        total += v[at]
    return 2.0 * total


def decode(order: list[Node], odds: np.ndarray) -> list[str]:
    """Text blocks of the best consistent labelling.

    Keeping a node is worth its log odds and those of the children worth
    keeping; a node whose worth is not positive goes with all below it.  The
    root is always kept.
    """
    worth = odds.astype(float).copy()
    for node in reversed(order):
        if node.size == 0:
            worth[node.order] = 0.0
        if node.parent is not None and worth[node.order] > 0:
            worth[node.parent.order] += worth[node.order]
    kept = np.zeros(len(order), bool)
    kept[0] = True
    out = []
    for node in order:
        if node.parent is not None:
            kept[node.order] = kept[node.parent.order] and worth[node.order] > 0
        if kept[node.order] and node.text:
            out.append(node.text)
    return out


def _extract(trees: list[tuple]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in text_chunks(batches, "html"):
            trees_of = [nodes_of(parse(h)) for h in pdf["html"]]
            x = [features(o) for o in trees_of]
            odds = np.split(log_odds(trees, np.concatenate(x)), np.cumsum([len(a) for a in x])[:-1]) if x else []
            text = ["\n\n".join(decode(o, w)) for o, w in zip(trees_of, odds)]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": text,
                                "n_chars": [len(t) for t in text]})
    return run


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                      html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)``: the main text of every page.

    Character references are decoded, white space inside a block becomes one
    blank, blocks are joined in page order by two line ends.  Null and empty
    pages, and pages without main text, give an empty text; broken markup is
    read as far as it goes; repeated rows are extracted each by itself, null
    ids and addresses stay null, an empty table gives no rows, other columns of
    ``pages`` are ignored.
    """
    src = spread(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                              F.col(html_col).cast("string").alias("html")))
    return src.mapInPandas(_extract(forest(pages.sparkSession)),
                           "page_id long, url string, text string, n_chars long")


N_FEATURES = len(FEATURES)
