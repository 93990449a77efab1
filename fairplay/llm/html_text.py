"""Main text of web pages by a tree-structured graphical model.

A page becomes its element tree. Every element has a hidden label, content or not,
a unary potential from what it looks like by itself (a sectioning tag, words in class, id
and role, kind of tag, length and punctuation of its own text, share of link text, depth,
place in the page), and a potential with its parent's label that depends on the kind of
element. Nothing is inherited but by messages: sum-product messages go up from the leaves
(long prose makes its container content) and down from the root (what is in an advert
or a menu is none) and give each element's marginal probability of content; the own text
of elements at one half or more is kept.

The potentials are counts, trained on the labelled pages of the same table: pages
that mark their article with exactly one <article> or <main> element. Its inside is
content but for navigation, header, footer, aside and form elements; class names
take no part in the labels. They are evidence: strong on containers (adverts, comments,
sharing bars are blocks), weak on paragraphs and other prose.
Each task reduces its pages to counts of (feature, value, label) and (kind, parent's
label, label), summed map-side; only these few hundred sums reach the driver.

Text: character references are decoded, scripts, styles, comments, markup and form
controls dropped, white space inside a block becomes one space, ends are trimmed,
and blocks (block-level elements) join in page order by one newline. A line break
element separates words, not blocks.

Cases: null or empty html gives the empty text; unclosed, unbalanced and deeply
nested markup is read without recursion; without labelled pages the potentials are the
expectations in ``START``; repeated pages are read each; an empty table gives an empty table; pages of
any length are read whole.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairplay.llm.common import carried

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z][^>]*>", re.S)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
TOKEN = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
HIDDEN = RAW | frozenset("head svg math button select option object canvas audio video datalist dialog".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
                   "strong sub sup time tt u var wbr".split())
#: An opening tag of the first closes an open element of the second in its container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "tbody": {"tr", "td", "th", "thead"}}
CONTAINERS = frozenset("ul ol dl table body article section div main td th blockquote html".split())
CONTENT = frozenset("article main".split())
CONTENT_WORDS = frozenset("article content entry post story main body text".split())
ASIDE = frozenset("nav header footer aside form menu fieldset".split())
FRAME = frozenset("#page html body".split())
SECTIONS = dict.fromkeys(CONTENT, "content") | dict.fromkeys(ASIDE, "aside") | dict.fromkeys(FRAME, "frame")
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb "
    "breadcrumbs header masthead footer foot sidebar aside widget related recommended cookie cookies consent gdpr notice popup modal "
    "overlay newsletter subscribe subscription signup login share sharing social comment comments reply replies respond discussion "
    "disqus pagination pager copyright legal disclaimer toolbar search form contentinfo complementary".split())
LAYOUT_WORDS = frozenset("with has no layout wrapper wrap container page".split())
KINDS = ("p", "li", "a", "pre", "blockquote", "div", "section", "td", "ul", "ol")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | frozenset("p pre blockquote td dd figcaption".split())
#: Part of a feature's probability that is spread evenly, so that no feature alone
#: outweighs the others however one-sided the training pages are; sections and blocks are surer.
SPREAD = {"section": 1e-6, "block": 1e-4, "hint": 0.5, "kind": 0.2, "own": 0.2, "links": 0.1, "ends": 0.3, "depth": 0.5, "place": 0.5}
#: Counts added to those of the pages: what is expected also where no page shows it.
START = {("section", "aside", "0"): 200, ("section", "content", "1"): 200, ("section", "frame", "0"): 200, ("block", "aside", "0"): 200, ("block", "content", "1"): 200,
         ("hint", "aside", "0"): 5, ("hint", "content", "1"): 5, ("own", "5", "1"): 4, ("own", "4", "1"): 2, ("kind", "p", "1"): 4,
         ("kind", "heading", "1"): 1, ("ends", "yes", "1"): 4, ("ends", "no", "0"): 4, ("links", "4", "0"): 4, ("links", "0", "1"): 2}
#: The features of looks depend on each other: their logarithms count by this share.
LOOKS, WEIGHT = frozenset("kind own links ends depth place hint".split()), 0.35
SMOOTH = 0.02
LEAK = 0.003  # an element differs from its parent so often at least
DIGITS = "0123456789"
Potentials = dict[tuple, tuple[float, float]]


class Page:
    """The element tree in document order, and the page's text pieces with block bounds."""

    def __init__(self, source: str):
        self.tags, self.parents, self.marks = ["#page"], [-1], [""]
        self.depths, self.ends = [0], [""]  # the last character of own text
        self.own, self.linked, self.before = [0], [0], [0]  # characters of own text, of link text inside, of all text before
        self.pieces: list[tuple[int, str] | None] = []  # (element, raw text); None: a block bound
        self._read(source)

    def _read(self, source: str) -> None:
        stack, at, hidden, so_far = [0], 0, 0, 0
        find, tags = TAG.search, self.tags
        while True:
            m = find(source, at)
            text = source[at:m.start()] if m else source[at:]
            if text and not hidden:
                self.pieces.append((stack[-1], text))
                body = text.strip()
                size = len(body)
                self.own[stack[-1]] += size
                so_far += size
                if size:
                    self.ends[stack[-1]] = body[-1]
                if size and any(tags[e] == "a" for e in stack[-4:]):
                    self.linked[stack[-1]] += size
            if not m:
                return
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag in tags and any(tags[e] == tag for e in stack):
                    while len(stack) > 1:
                        gone = tags[stack.pop()]
                        hidden -= gone in HIDDEN
                        if gone not in INLINE:
                            self.pieces.append(None)
                        if gone == tag:
                            break
                continue
            hidden -= self._close(stack, tag)
            if tag not in INLINE:
                self.pieces.append(None)
            elif tag == "br" and not hidden:
                self.pieces.append((stack[-1], " "))
            if tag in VOID or m[3].endswith("/"):
                continue
            tags.append(tag)
            self.parents.append(stack[-1])
            self.marks.append(words_of(m[3]) if m[3] else "")
            self.depths.append(len(stack))
            self.ends.append("")
            self.before.append(so_far)
            self.own.append(0)
            self.linked.append(0)
            if tag in RAW:
                end = re.compile(f"</{tag}\\s*>", re.I).search(source, at)
                at = end.end() if end else len(source)
                continue
            stack.append(len(tags) - 1)
            hidden += tag in HIDDEN

    def _close(self, stack: list[int], tag: str) -> int:
        """Ends the elements that the opening of ``tag`` implies; how many were hidden."""
        if tag == "body" and any(self.tags[e] == "head" for e in stack):
            inside = {"head"}
        elif tag in CLOSES:
            inside = CLOSES[tag]
        elif tag not in INLINE:
            inside = {"p"}
        else:
            return 0
        for depth in range(len(stack) - 1, 0, -1):
            name = self.tags[stack[depth]]
            if name in inside:
                gone = stack[depth:]
                del stack[depth:]
                self.pieces.append(None)
                return sum(self.tags[e] in HIDDEN for e in gone)
            if name in CONTAINERS and not (tag in ("tr", "tbody") and name in ("td", "th")):
                return 0
        return 0

    def features(self) -> list[list[tuple[str, str]]]:
        """(feature, value) pairs of every element."""
        n = len(self.tags)
        total, linked = self.own[:], self.linked[:]
        for e in range(n - 1, 0, -1):
            total[self.parents[e]] += total[e]
            linked[self.parents[e]] += linked[e]
        whole = max(1, total[0])
        out = []
        for e in range(n):
            tag, kind = self.tags[e], self.kind(e)
            found = [("kind", kind)]
            if tag in SECTIONS:
                found.append(("section", SECTIONS[tag]))
            if self.marks[e] and tag not in FRAME:
                found.append(("hint" if tag in PROSE or tag in INLINE else "block", self.marks[e]))
            if kind != "inline":  # that is what its block is
                if total[e]:
                    found.append(("links", DIGITS[4 * linked[e] // total[e]]))
                if self.own[e]:
                    found += [("own", DIGITS[min(5, (self.own[e].bit_length() + 1) // 2)]),
                              ("ends", "yes" if self.ends[e] in ".!?:;\"" else "no"),
                              ("place", DIGITS[min(4, 5 * self.before[e] // whole)])]
                found.append(("depth", DIGITS[min(9, self.depths[e])]))
            out.append(found)
        return out

    def kind(self, e: int) -> str:
        tag = self.tags[e]
        if tag in KINDS:
            if tag == "a" and (p := self.tags[self.parents[e]]) in INLINE | PROSE:
                return "inline" if p != "a" else "a"
            return tag
        return "heading" if tag in HEADINGS else "inline" if tag in INLINE else "other"

    def truth(self) -> list[int] | None:
        """Labels of a page that marks its article, else None: by elements, not by words."""
        if sum(t in CONTENT for t in self.tags) != 1:
            return None
        labels = [0] * len(self.tags)
        for e in range(1, len(self.tags)):
            labels[e] = int(self.tags[e] in CONTENT or bool(labels[self.parents[e]]) and self.tags[e] not in ASIDE)
        return labels

    def text(self, keep: list[bool]) -> str:
        blocks, part = [], []
        for piece in [*self.pieces, None]:
            if piece is None:
                if part:
                    blocks.append(" ".join(html.unescape("".join(part)).split()))
                    part = []
            elif keep[piece[0]]:
                part.append(piece[1])
        return "\n".join(b for b in blocks if b)


def words_of(attributes: str) -> str:
    """What class, id and role say: content, aside, or nothing."""
    words = {w for _, v in ATTRIBUTE.findall(attributes) for w in TOKEN.findall(v.lower())}
    if words & ASIDE_WORDS:
        return "" if words & LAYOUT_WORDS else "aside"
    return "content" if words & CONTENT_WORDS else ""


def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sufficient statistics of a task's labelled pages: (feature, value, label, n)."""
    seen: Counter[tuple] = Counter()
    for pdf in batches:
        for source in pdf["html"]:
            page = Page(source or "")
            labels = page.truth()
            if labels is None:
                continue
            for e, found in enumerate(page.features()):
                seen.update((f, v, DIGITS[labels[e]]) for f, v in found)
                if e:
                    seen[("pair", f"{page.kind(e)} {labels[page.parents[e]]}", str(labels[e]))] += 1
    yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["feature", "value", "label", "n"])


def train(pages: DataFrame, html_column: str = "html") -> Potentials:
    """Log potentials from the labelled pages; a few hundred numbers."""
    rows = (pages.select(F.col(html_column).alias("html")).mapInPandas(counts, "feature string, value string, label string, n long")
            .groupBy("feature", "value", "label").agg(F.sum("n").alias("n")).collect())
    n = {(r["feature"], r["value"], r["label"]): r["n"] for r in rows}
    for k, start in START.items():
        n[k] = n.get(k, 0) + start
    return potentials(n)


def potentials(n: dict[tuple[str, str, str], float]) -> Potentials:
    """Logarithms of the smoothed shares in the counts (feature, value, label) -> n."""
    out: Potentials = {}
    for f, spread in SPREAD.items():
        values = {k[1] for k in n if k[0] == f}
        even = spread / (len(values) + 1)
        total = [sum(n.get((f, v, y), 0) for v in values) + SMOOTH * len(values) for y in "01"]
        for v in values:
            by = WEIGHT if f in LOOKS else 1.0
            out[f, v] = tuple(by * math.log((1 - spread) * (n.get((f, v, y), 0) + SMOOTH) / t + even) for y, t in zip("01", total, strict=True))
    for k in (*KINDS, "heading", "inline", "other"):
        for parent in "01":
            same = 200.0 if k == "inline" else 50.0
            other = SMOOTH if k in ("p", "heading", "inline", "pre", "blockquote") or parent == "0" else same / 2  # blocks in content may be none
            near = [n.get(("pair", f"{k} {parent}", y), 0) + (same if y == parent else other) for y in "01"]
            out["pair", f"{k} {parent}"] = tuple(math.log((1 - 2 * LEAK) * x / sum(near) + LEAK) for x in near)
    return out


def marginals(page: Page, model: Potentials) -> list[float]:
    """Probability of content of each element, by sum-product up and down the tree."""
    unknown = (0.0, 0.0)
    n = len(page.tags)
    unary = []
    for found in page.features():
        a = b = 0.0
        for f, v in found:
            x = model.get((f, v), unknown)
            a += x[0]
            b += x[1]
        unary.append((a, b))
    kinds = [page.kind(e) for e in range(n)]
    pair = [(model["pair", f"{k} 0"], model["pair", f"{k} 1"]) for k in kinds]
    up = [None] * n
    gathered = [list(u) for u in unary]
    for e in range(n - 1, 0, -1):  # children come after their parents
        g0, g1 = gathered[e]
        (t00, t01), (t10, t11) = pair[e]
        up[e] = (_sum(t00 + g0, t01 + g1), _sum(t10 + g0, t11 + g1))
        into = gathered[page.parents[e]]
        into[0] += up[e][0]
        into[1] += up[e][1]
    out = [0.0] * n
    down = [(0.0, -2.0)] * n  # of the page as a whole; the others follow
    for e in range(n):
        if e:
            p = page.parents[e]
            g0, g1 = gathered[p][0] - up[e][0] + down[p][0], gathered[p][1] - up[e][1] + down[p][1]
            (t00, t01), (t10, t11) = pair[e]
            m = _sum(t00 + g0, t10 + g1), _sum(t01 + g0, t11 + g1)
            top = max(m)
            down[e] = (m[0] - top, m[1] - top)
        d = gathered[e][0] + down[e][0] - gathered[e][1] - down[e][1]
        out[e] = 1 / (1 + math.exp(min(700.0, d)))
    return out


def _sum(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html_column: str = "html",
            model: Potentials | None = None) -> DataFrame:
    """(key, url, text, n_chars, n_elements, n_content) of every page."""
    told = pages.sparkSession.sparkContext.broadcast(model or train(pages, html_column))
    types = dict(pages.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for source in pdf["h"]:
                page = Page(source or "")
                keep = [p >= 0.5 for p in marginals(page, told.value)]
                text = page.text(keep)
                rows.append((text, len(text), len(keep), sum(keep)))
            yield pd.concat([pdf[["k", "u"]].reset_index(drop=True),
                             pd.DataFrame(rows, columns=["text", "n_chars", "n_elements", "n_content"])], axis=1)

    kind = types[key]
    slim = pages.select(F.col(key).cast(carried(kind)).alias("k"), F.col(url).alias("u"), F.col(html_column).alias("h"))
    out = slim.mapInPandas(run, f"k {carried(kind)}, u {types[url]}, text string, n_chars long, n_elements long, n_content long")
    return out.withColumn("k", F.col("k").cast(kind)).withColumnRenamed("k", key).withColumnRenamed("u", url)
