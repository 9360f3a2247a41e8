"""Main text of web pages by minimum-cut labelling.

A page is split into blocks, the runs of text between block-level tags. A logistic regression over a
block's length, punctuation, links, place, element and the names around it gives its log-odds of being
content; bounded by CAP they are the capacity that ties the block to the source (content) if positive,
to the sink (boilerplate) if negative. It is trained on pages of many layouts that are made here with
their main text known (_layouts). Smoothness edges tie each block to the one before it, and to the
block before it under the same parent, the more the nearer the two are in the document tree. CAP is of
the edges' scale, so that neighbours can overrule the classifier on any block that no mark tells of. The
maximum flow leaves the cut of least cost; blocks still reached from the source are the main text.

Text of scripts, styles, forms' fields and other elements that are never shown as prose makes no
block. Nothing is dropped or capped besides.

Defined results: a null or empty page, and one without content, has the text ""; white space is
what Unicode calls so, no-break spaces included; markup without an end reaches to the page's end;
repeated rows each keep their own; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable
from functools import lru_cache
from html import unescape
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm._base import frugal, table
from palimpsest.llm._layouts import layout

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<svg(?=[\s/>])(?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+(?<=/)>"
    r"|<(script|style|noscript|template|svg|iframe|object|canvas|select|textarea|title|button|audio|video|annotation|annotation-xml)(?=[\s/>])[^>]*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)>"
    r"|<[/!?a-zA-Z][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr del input math mi mo mn ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mtable mtr mtd mstyle mspace mpadded mphantom menclose semantics".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_BOILER_TAG = frozenset("nav footer aside form menu dialog head fieldset".split())
_BOILER = frozenset(
    "ad ads advert advertisement adverts adsense banner sponsor sponsored promo promoted promotion nav navbar navigation menu breadcrumb breadcrumbs footer header masthead topbar sidebar aside widget "
    "related recommended recommendations share sharing social follow newsletter subscribe subscription signup login cookie cookies consent gdpr notice notices alert popup modal overlay toolbar pagination pager tags "
    "skip skiplink legal copyright disclaimer search form toc byline meta".split()
)
_BOILER_ROLE = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar form toolbar".split())
#: First parts of names that say how a page is laid out or filed, and last parts that say where a part stands.
_FILED = frozenset("with has no without is category tag type format status theme postid page single template".split())
_LAYOUT = frozenset("right left fixed sticky wide narrow full top bottom on off open enabled disabled visible".split())
_COMMENTS = frozenset("comment comments commentlist disqus respond response reply replies discussion remarks responses".split())
_MAIN = frozenset("article articlebody post entry story content main body text prose hentry".split())
_CUES = re.compile(r"^(?:©|\(c\)|copyright\b|share\b|follow\b|sign up\b|log in\b|subscribe\b|advertisement\b|powered by\b)|\b(?:cookies?|newsletter|all rights reserved|privacy policy|terms of use|subscribe|register)\b", re.I)
_PARTS = re.compile(r"[^a-z0-9]+")


def named(value: str) -> int:
    """What the names of an element say: 1 main text, -1 boilerplate, 0 nothing, 2 readers' comments."""
    main = boiler = False
    for name in value.split():
        parts = [x for x in _PARTS.split(name) if x]
        if not parts or parts[0] in _FILED:
            continue
        if not _COMMENTS.isdisjoint(parts):
            return 2
        if parts[-1] in _BOILER or parts[0] in _BOILER and parts[-1] not in _LAYOUT:
            boiler = True
        elif not _MAIN.isdisjoint(parts):
            main = True
    return -1 if boiler else int(main)


class Place:
    """An open element: its parent and depth; tagged: the nearest mark by element or role, named: the
    nearest by name (1 main text, -1 boilerplate); whether it is among readers' comments or hidden."""

    __slots__ = ("tag", "parent", "depth", "tagged", "named", "comments", "hidden", "last")

    def __init__(self, tag: str, attributes: str, parent: Place | None):
        self.tag, self.parent, self.last = tag, parent, -1
        if parent is None:
            self.depth, self.tagged, self.named, self.comments, self.hidden = 0, 0, 0, False, False
        else:
            self.depth, self.tagged, self.named, self.comments, self.hidden = parent.depth + 1, parent.tagged, parent.named, parent.comments, parent.hidden
        main = tag == "main" or tag == "article" and not (self.tagged < 0 and parent.within("aside", "nav", "footer"))
        if main:
            self.tagged, self.named = 1, 0  # names such as with-sidebar on what holds the article say nothing
        elif tag in _BOILER_TAG or tag == "header" and self.tagged < 1:
            self.tagged = -1
        if attributes and tag not in ("html", "body"):
            names = []
            for key, value in _ATTRIBUTE.findall(attributes):
                key, value = key.lower(), value.strip("\"'").lower()
                if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
                    self.hidden = True
                elif key == "role":
                    self.tagged = -1 if value in _BOILER_ROLE else 1 if value == "main" else self.tagged
                elif key != "style":
                    names.append(value)
            says = named(" ".join(names)) if names else 0
            if says == 2:
                self.comments = True
            elif says and not main:
                self.named = says

    def within(self, *tags: str) -> bool:
        up = self
        while up is not None and up.tag not in tags:
            up = up.parent
        return up is not None


_ELEMENTS = {"p": 0, "h1": 1, "h2": 2, "h3": 2, "h4": 2, "li": 3, "td": 4, "th": 4, "dt": 4, "dd": 4, "blockquote": 5, "pre": 5, "figcaption": 5}
FEATURES = 22


class Block:
    __slots__ = ("text", "place", "linked", "odds")

    def __init__(self, text: str, place: Place, linked: int):
        self.text, self.place, self.linked, self.odds = text, place, linked, 0.0

    def features(self, at: float) -> list[float]:
        """at: the share of the page's text before the block."""
        text, place = self.text, self.place
        words, density = text.count(" ") + 1, min(1.0, self.linked / len(text))
        size = log1p(min(words, 300))  # longer blocks are told by no more
        element = [0.0] * 7
        element[_ELEMENTS.get(place.tag, 6)] = 1.0
        cue, outside = words < 30 and _CUES.search(text) is not None, place.tagged < 1 and place.named < 1
        marks = text.count(",") + text.count(".") + text.count("?") + text.count("!")
        return [
            1.0, size, size**2 / 5, density, density * size, float(text[-1] in ".!?…»”\"'"), min(1.0, marks / words), float(cue), float(cue and outside),
            at, at * at, min(place.depth, 20) / 10, float(place.tagged > 0) - float(place.tagged < 0), float(place.tagged < 0), float(place.named > 0), *element,
        ]

    def marked(self) -> bool:
        """Whether the page itself says that this is no main text: its classifier's feature is learnt, but comments and what is hidden are so by definition."""
        return self.place.comments or self.place.hidden


def split(html: str) -> list[Block]:
    """The page's blocks in order."""
    out: list[Block] = []
    at, here = 0, Place("", "", None)
    parts: list[str] = []
    in_link, linked = False, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append(Block(text, here, linked))
        linked = 0

    for m in _TOKEN.finditer(html):
        if m.start() > at:
            parts.append(html[at : m.start()])
            if in_link:
                linked += m.start() - at
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _INLINE:
            if tag == "a":
                in_link = not m[2]
            elif tag == "br":
                parts.append(" ")
            continue
        if parts:
            flush()
        in_link = False
        if m[2]:
            up = here
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None and up.parent is not None:
                here = up.parent
            continue
        if tag in _VOID:
            continue
        if tag in _ENDS_P:
            if here.tag == "p":
                here = here.parent
        elif tag in _SELF_CLOSING:
            while here.tag == "p" or here.tag in _SELF_CLOSING[tag]:
                here = here.parent
        elif tag == "body":  # ends a head left open
            while here.parent is not None and here.tag != "html":
                here = here.parent
        here = Place(tag, m[4], here)
        if m[4].endswith("/") and tag not in _ENDS_P and tag not in _SELF_CLOSING:
            here = here.parent
    parts.append(html[at:])
    flush()
    return out


def apart(a: Place, b: Place) -> int:
    """Edges between two elements in the document tree."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the source's side of a minimum cut, by Dinic's blocking flows. A
    node is tied to the source by max(odds, 0) and to the sink by max(-odds, 0)."""
    n = len(odds)
    plus, minus = [max(x, 0.0) for x in odds], [max(-x, 0.0) for x in odds]
    near: list[list[int]] = [[] for _ in range(n)]
    head, room = [], []
    for a, b, c in edges:
        near[a].append(len(head))
        near[b].append(len(head) + 1)
        head += (b, a)
        room += (c, c)
    small = 1e-9
    while True:
        level = [-1] * n
        queue = deque(k for k in range(n) if plus[k] > small)
        for k in queue:
            level[k] = 0
        starts, reached = list(queue), False
        while queue:
            k = queue.popleft()
            if minus[k] > small:
                reached = True
            for e in near[k]:
                if room[e] > small and level[head[e]] < 0:
                    level[head[e]] = level[k] + 1
                    queue.append(head[e])
        if not reached:
            return [x >= 0 for x in level]
        turn = [0] * n
        for s in starts:
            while plus[s] > small:
                path, k = [], s
                while True:
                    if minus[k] > small:
                        flow = min([plus[s], minus[k], *(room[e] for e in path)])
                        plus[s] -= flow
                        minus[k] -= flow
                        for e in path:
                            room[e] -= flow
                            room[e ^ 1] += flow
                        break
                    while turn[k] < len(near[k]):
                        e = near[k][turn[k]]
                        if room[e] > small and level[head[e]] == level[k] + 1:
                            break
                        turn[k] += 1
                    else:
                        if not path:
                            k = -1
                            break
                        k = head[path.pop() ^ 1]
                        turn[k] += 1
                        continue
                    path.append(e)
                    k = head[e]
                if k < 0:
                    break


#: The bound of a block's log-odds, and the edges' capacities: of all neighbours, and besides by nearness in the tree.
CAP, ADJACENT, PROXIMITY = 4.0, 0.5, 1.5


def describe(blocks: list[Block]) -> np.ndarray:
    """One row of features per block."""
    sizes = np.cumsum([0, *(len(b.text) for b in blocks)])
    rows = [[*b.features(a / max(sizes[-1], 1)), float(b.place.named < 0)] for b, a in zip(blocks, sizes.tolist())]
    return np.array(rows, float).reshape(len(blocks), FEATURES + 1)


@lru_cache(maxsize=4)
def train(pages: int = 600, first: int = 0, l2: float = 1.0) -> tuple[float, ...]:
    """The classifier's weights: logistic regression by Newton's steps on the blocks of made pages."""
    x, y = [], []
    for seed in range(first, first + pages):
        html, content = layout(seed)
        blocks = split(html)
        rows = describe(blocks)
        for b, row in zip(blocks, rows):
            if not b.marked():
                x.append(row)
                y.append(b.text in content)
    x, y = np.array(x), np.array(y, float)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w)), x.T @ (y - p) - l2 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def neighbours(blocks: list[Block], adjacent: float, proximity: float) -> list[tuple[int, int, float]]:
    edges: list[tuple[int, int, float]] = []
    for k, b in enumerate(blocks):
        if k:
            edges.append((k - 1, k, adjacent + proximity / (1 + apart(blocks[k - 1].place, b.place))))
        holder = b.place.parent or b.place
        if 0 <= holder.last < k - 1:
            edges.append((holder.last, k, proximity / (1 + apart(blocks[holder.last].place, b.place))))
        holder.last = k
    return edges


def labelled(html: str, weights: tuple[float, ...], adjacent: float = ADJACENT, proximity: float = PROXIMITY, cap: float = CAP) -> list[tuple[Block, bool]]:
    """The page's blocks, with their odds set, and whether the cut leaves them on content's side."""
    blocks = split(html)
    if not blocks:
        return []
    for b, o in zip(blocks, (describe(blocks) @ np.array(weights)).tolist()):
        b.odds = -2 * cap if b.marked() else max(-cap, min(cap, o))
    edges = neighbours(blocks, adjacent, proximity)
    if all(b.odds > 0 for b in blocks):
        return [(b, True) for b in blocks]
    return list(zip(blocks, minimum_cut([b.odds for b in blocks], edges)))


def main_blocks(html: str | None, weights: tuple[float, ...] | None = None) -> list[str]:
    """The texts of the blocks that are content, in page order."""
    return [b.text for b, content in labelled(html or "", weights or train()) if content]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars."""
    kinds, weights = dict(pages.dtypes), train()

    def go(batches):
        for b in batches:
            texts = ["\n\n".join(main_blocks(x.as_py(), weights)) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["c0", "c1", "text", "n_chars"])

    given = pages.select(*(pages[c].alias(f"c{k}") for k, c in enumerate((id_col, url_col, html_col))))
    out = given.mapInArrow(frugal(go), f"c0 {kinds[id_col]}, c1 {kinds[url_col]}, text string, n_chars long")
    return out.withColumnsRenamed({"c0": id_col, "c1": url_col})


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable] = {"op2_html_extract": op2_html_extract}
ORACLE: dict[str, str] = {}
