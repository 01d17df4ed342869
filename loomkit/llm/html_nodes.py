"""DOM trees of raw pages, and what a node of one looks like to a classifier.

Nodes are block elements; a run of text between the blocks of a container is a
node of its own, so every piece of text belongs to exactly one leaf.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import numpy as np

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style head title noscript template svg math iframe object canvas select textarea button".split())
BLOCK = frozenset(("html body div section article main nav header footer aside p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd "
                   "table thead tbody tfoot tr td th caption blockquote pre figure figcaption form fieldset address "
                   "details summary dialog hr center").split())
ENDS_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dt", "dd"}
SIBLING_ENDS = {"li": ("li", "ul", "ol"), "dt": ("dt dd", "dl", "dl"), "dd": ("dt dd", "dl", "dl"),
                "tr": ("tr", "table", "table"), "td": ("td th", "tr", "table"), "th": ("td th", "tr", "table")}
TAGS = ["article main", "section div center body html", "p", "h1 h2 h3 h4 h5 h6", "ul ol dl", "li dt dd", "nav", "header",
        "footer", "aside", "table thead tbody tfoot tr td th caption", "blockquote pre figure figcaption",
        "form fieldset", "details summary dialog address", "#text"]
# Attribute words by what they announce.
WORDS = {
    "main": "article content main post body entry story text prose markdown narrative",
    "nav": "nav menu breadcrumb breadcrumbs pagination pager toc tabs navbar topnav links",
    "header": "header masthead banner logo top brand topbar",
    "footer": "footer colophon copyright legal bottom imprint",
    "side": "sidebar aside widget rail secondary related recommended popular trending teaser more",
    "ad": "ad ads advert advertisement adsense promo sponsor sponsored promotion dfp commercial",
    "comment": "comment comments reply replies discussion respond disqus thread feedback reviews",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe paywall toast warning",
    "form": "form login signup register search contact",
    "share": "share social sharing follow tags meta byline tools toolbar",
}
_KIND = {w: k for k, ws in WORDS.items() for w in ws.split()}
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_PUNCT = re.compile(r"[.,;:!?]")


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "parts", "links", "depth", "order", "label", "size",
                 "link_size", "leaves", "punct", "start", "kinds", "text")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node] = []
        self.parts: list[str] | None = None  # text of a leaf
        self.links = 0
        self.depth = parent.depth + 1 if parent else 0
        self.label = None


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", "", None)
        self.silent: list[str] = []
        self.leaf: Node | None = None
        self.in_link = 0

    def handle_starttag(self, tag, attrs):
        if self.silent == ["head"] and tag in BLOCK and tag != "html":
            self.silent.clear()  # a head that nothing closed
        if self.silent:
            if tag == self.silent[-1] and tag not in VOID:
                self.silent.append(tag)
            return
        if tag in SILENT:
            self.silent.append(tag)
            self._space()
            return
        if tag == "a":
            self.in_link = 1
        if tag == "br":
            self._space()
        if tag not in BLOCK:
            return
        self.leaf, self.in_link = None, 0
        said = " ".join(v for k, v in attrs if v and k in ("class", "id", "role", "data-label", "itemprop", "aria-label"))
        if tag in ("html", "body"):
            self.at = self.at if self.at.depth else self.root
            self.root.attrs += " " + said
            return
        if tag in ENDS_P:
            self._close("p", "div section article main td th li body table")
        if tag in SIBLING_ENDS:
            closes, *stops = SIBLING_ENDS[tag]
            self._close(closes, " ".join(stops))
        if tag == "hr":
            return
        node = Node(tag, said, self.at)
        self.at.children.append(node)
        self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in SILENT or tag in BLOCK and tag != "hr":
            self.handle_endtag(tag)

    def _close(self, tags: str, stops: str) -> None:
        """Close the nearest open element of ``tags``, unless a stop is nearer."""
        wanted, stop, node = tags.split(), stops.split(), self.at
        while node.depth and node.tag not in stop:
            if node.tag in wanted:
                self.at = node.parent
                return
            node = node.parent

    def handle_endtag(self, tag):
        if self.silent:
            if tag == self.silent[-1]:
                self.silent.pop()
            return
        if tag == "a":
            self.in_link = 0
        if tag not in BLOCK or tag in ("html", "body"):
            return
        self.leaf, self.in_link, node = None, 0, self.at
        while node.depth and node.tag != tag:
            node = node.parent
        if node.depth:
            self.at = node.parent

    def _space(self):
        if self.leaf is not None:
            self.leaf.parts.append(" ")

    def handle_data(self, data):
        if self.silent:
            return
        if self.leaf is None:
            if not data.strip():
                return
            self.leaf = Node("#text", "", self.at)
            self.leaf.parts = []
            self.at.children.append(self.leaf)
        self.leaf.parts.append(data)
        if self.in_link:
            self.leaf.links += len(data.strip())


def parse(html: str | None) -> Node:
    """The tree of a page; broken or empty markup gives what can be read."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def nodes_of(root: Node) -> list[Node]:
    """All nodes in page order; a block whose only child is text becomes a leaf.
    Fills in the sizes that features need.  Iterative: trees may be deep."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if len(node.children) == 1 and node.children[0].tag == "#text" and node.depth:
            only = node.children[0]
            node.parts, node.links, node.children = only.parts, only.links, []
        node.order = len(order)
        order.append(node)
        stack.extend(reversed(node.children))
    start = 0
    for node in order:
        node.start = start
        node.text = ""
        if node.parts is not None:
            node.text = _SPACE.sub(" ", "".join(node.parts)).strip()
            start += len(node.text)
        node.size, node.link_size = len(node.text), min(node.links, len(node.text))
        node.leaves, node.punct = int(bool(node.text)), len(_PUNCT.findall(node.text))
        kinds = [_KIND[w] for w in map(str.lower, _TOKEN.findall(node.attrs)) if w in _KIND] if node.attrs else []
        node.kinds = frozenset(kinds)
    for node in reversed(order):
        if node.parent is not None:
            up = node.parent
            up.size += node.size
            up.link_size += node.link_size
            up.leaves += node.leaves
            up.punct += node.punct
    return order


_TAG_OF = {t: i for i, ts in enumerate(TAGS) for t in ts.split()}
_KINDS = list(WORDS)
BASE = ["log_size", "page_share", "link_share", "log_leaves", "size_per_leaf", "punctuation", "depth", "start",
        "siblings", "sibling_size", "same_tag", "before_size", "after_size", "parent_link_share", "parent_share",
        "in_main", "in_chrome", "attributes"]
FEATURES = BASE + [f"tag:{t.split()[0]}" for t in TAGS] + [f"own:{k}" for k in _KINDS] + [f"above:{k}" for k in _KINDS]


def features(order: list[Node]) -> np.ndarray:
    """One row of ``FEATURES`` per node."""
    x = np.zeros((len(order), len(FEATURES)), np.float32)
    total = max(1, order[0].size)
    above: list[tuple] = [None] * len(order)
    n_base, n_tags, n_kinds = len(BASE), len(TAGS), len(_KINDS)
    for node in order:
        up, row = node.parent, x[node.order]
        mine = _TAG_OF.get(node.tag, 1)
        if up is None:
            kinds, main, chrome, sibs, place = frozenset(), 0, 0, order[:1], 0
        else:
            got = above[up.order]
            kinds, main, chrome = got[0] | up.kinds, got[1], got[2]
            sibs, place = up.children, got[3]
            above[up.order] = (*got[:3], place + 1)
        main = main or mine == 0
        chrome = chrome or 6 <= mine <= 9
        above[node.order] = (kinds, main, chrome, 0)
        k = len(sibs)
        row[:n_base] = (
            math.log1p(node.size), node.size / total, node.link_size / max(1, node.size), math.log1p(node.leaves),
            node.size / max(1, node.leaves), 100 * node.punct / max(1, node.size), node.depth, node.start / total,
            math.log1p(k), (up.size - node.size) / max(1, k - 1) if up and k > 1 else 0,
            0.0, sibs[place - 1].size if place else 0, sibs[place + 1].size if place + 1 < k else 0,
            up.link_size / max(1, up.size) if up else 0, up.size / total if up else 1, main, chrome,
            bool(node.attrs.strip()))
        row[n_base + mine] = 1
        for i, kind in enumerate(_KINDS):
            if kind in node.kinds:
                row[n_base + n_tags + i] = 1
            if kind in kinds:
                row[n_base + n_tags + n_kinds + i] = 1
    for node in order:  # share of siblings with the same tag, per parent in one go
        if node.children:
            count: dict[str, int] = {}
            for c in node.children:
                count[c.tag] = count.get(c.tag, 0) + 1
            for c in node.children:
                x[c.order, 10] = count[c.tag] / len(node.children)
    return x
