"""Main text of web pages by tag-path ratios.

A page is read as a stream of tags into blocks of text, each under a root-to-leaf path of tags (with class and id).
Text length, punctuation and linked length are summed for each path; the ratios of text and punctuation to the path's
blocks are added, smoothed with those of the paths that share its parent, lowered by the share of text in links, and
compared with a share of the page's best. Headings, list items and cells next to selected blocks, or between them, pass
as well, unless they are mostly links. Where the page has article or main elements, paths outside are lowered by a
bounded factor: the more, the more of the text lies inside. Paths below menus, headers, footers, sidebars, notices,
adverts, forms and comments never pass. A word of class, id or role marks an element as one of these only if the element
is no wrapper: if it does not hold the page's largest article or main element, nor most of the page's text.
Selected blocks keep the page's order.

Null and empty pages give an empty text. Repeated rows are extracted each; a column named as the output is replaced.
Unclosed, misnested and cut-off markup is read as far as it goes; time and memory are linear in the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from itertools import islice
from math import log1p
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose text is never main text.
APART = frozenset("head nav footer aside form menu script style textarea title noscript template iframe svg math button select option dialog object audio video canvas".split())
#: Words of class, id or role that mark an element as apart.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead comment comments disqus respond reply replies share sharing social related recommended newsletter subscribe signup login search pagination pager toolbar widget complementary contentinfo".split()
)
#: Those that mark even an article.
ARTICLE_MARKS = frozenset("comment comments reply replies ad ads advert advertisement promo sponsored related teaser".split())
MAIN = {"article": 1, "main": 2}
#: Words of comments, which can be longer than what they comment on.
COMMENT_MARKS = frozenset("comment comments disqus respond reply replies".split())
#: Share of the page's text that a marked element must hold to be a wrapper of main text, likewise one marked by words of comments; and how many times the text of the largest article, if that is outside.
WRAPPER, COMMENT_WRAPPER, TIMES_ARTICLE = 0.5, 0.9, 4
#: Elements whose blocks pass beside selected ones.
BESIDE = frozenset("h1 h2 h3 h4 h5 h6 li dt dd td th caption figcaption summary".split())
#: Elements that a start tag closes when they are open, up to an element that holds them.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
HOLDS_P = frozenset("article aside blockquote body button center dd div dl fieldset figure footer form header li main nav section table td th ul ol".split())
_INLINE_BLOCK = BLOCK - {"br", "html", "head", "body", "option", "tr", "td", "th", "tbody", "thead", "tfoot"}

#: Of the page's best score, the share that a path must reach.
CUT = 0.15
#: The least factor of paths outside of article and main elements.
OUTSIDE = 0.05
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none""", re.I)
_PARTS = re.compile(r"[A-Za-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…、。，،]")


def _names(attributes: str, tag: str) -> tuple[str, set[str], bool]:
    """(class and id for the path, words that mark the element as apart, whether it is hidden)."""
    if not attributes or attributes.isspace():
        return "", set(), False
    found = [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in _NAMES.finditer(attributes)]
    marks = {p.lower() for _, v in found for p in _PARTS.findall(v)} & (ARTICLE_MARKS if tag in MAIN else MARKS)
    return "".join(f"{'#' if k == 'id' else '.'}{v.replace('/', '|')}" for k, v in found), marks, bool(_HIDDEN.search(attributes))


class Tree:
    """Numbered nodes, each after its parent: root-to-leaf paths of a page, or its marked elements. Node 0 is the root."""

    def __init__(self):
        self.parents, self.labels = [0], [""]

    def add(self, parent: int, label) -> int:
        self.parents.append(parent)
        self.labels.append(label)
        return len(self.parents) - 1

    def above(self, node: int) -> Iterator[int]:
        while node:
            yield node
            node = self.parents[node]


class Block(NamedTuple):
    """A block of text: its path, whether it is apart, 1 in an article and 2 in a main element, the text, how much of it is linked."""

    path: int
    apart: bool
    main: int
    text: str
    linked: int
    mark: int = 0
    article: int = 0


class Open(NamedTuple):
    """An open element: what Block says of its text, the place on the stack of the nearest element that holds paragraphs, whether it is in a link."""

    tag: str
    path: int
    apart: bool
    main: int
    mark: int
    article: int
    holds: int
    link: bool


def _void(found: list[Block], marks: Tree) -> list[bool]:
    """Of each marked element, whether it or one around it is apart indeed."""
    held, articles, total = [0] * len(marks.parents), {}, 0
    for b in found:
        total += len(b.text)
        if not b.apart:
            held[b.mark] += len(b.text)
            if b.article:
                articles[b.article] = articles.get(b.article, 0) + len(b.text)
    for k in range(len(held) - 1, 0, -1):
        held[marks.parents[k]] += held[k]
    largest = max(articles, key=articles.get, default=0)
    around = next((set(marks.above(b.mark)) for b in found if b.article == largest and not b.apart), set()) if largest else set()
    out = [False] * len(held)
    for k in range(1, len(held)):
        place, words = marks.labels[k]
        wrapper = k in around and place < largest
        small = held[k] < (COMMENT_WRAPPER if words & COMMENT_MARKS else WRAPPER) * total or held[k] < TIMES_ARTICLE * articles.get(largest, 0)
        out[k] = out[marks.parents[k]] or (small and not wrapper)
    return out


class Reader:
    """Reads a page into blocks. The stack of open elements knows the places of each kind, so that no tag has to walk it."""

    def __init__(self):
        self.paths, self.marks = Tree(), Tree()
        self.stack, self.places = [Open("", 0, False, 0, 0, 0, 0, False)], {}
        self.known: dict[tuple[int, str], int] = {}
        self.found: list[Block] = []
        self.buffer: list[str] = []
        self.place, self.linked = self.stack[0], 0

    def last(self, tags) -> int:
        """The place on the stack of the innermost open element of some kinds, 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, at: int) -> None:
        while len(self.stack) > at:
            self.places[self.stack.pop().tag].pop()

    def flush(self) -> None:
        if self.buffer:
            if text := " ".join(unescape("".join(self.buffer)).split()):
                p = self.place
                self.found.append(Block(p.path, p.apart, p.main, text, self.linked, p.mark, p.article))
            self.buffer.clear()
        self.linked = 0

    def add(self, text: str) -> None:
        if not text:
            return
        top, place = self.stack[-1], self.place
        if self.buffer and (top.apart, top.main, top.mark) != (place.apart, place.main, place.mark):
            if (top.apart and not place.apart) or top.mark > place.mark:
                return  # an inline part apart is left out of its block
            self.flush()
        if not self.buffer:
            self.place = top
        self.buffer.append(text)
        if top.link:
            self.linked += len(text)

    def end(self, tag: str) -> None:
        at = self.last((tag,))
        if at and (tag in ("html", "body") or at >= self.last(MAIN)):  # an end tag does not reach out of an article
            self.close(at)

    def start(self, tag: str, attributes: str, place: int) -> None:
        if tag in _INLINE_BLOCK and (at := self.last("p")) > self.stack[-1].holds:
            self.close(at)
        if tag in CLOSES:
            shut, hold = CLOSES[tag]
            if (at := self.last(shut)) > self.last(hold):
                self.close(at)
        name, marked, hidden = _names(attributes, tag)
        above = self.stack[-1]
        apart = above.apart or tag in APART or (tag == "header" and not above.main) or (hidden and tag not in ("html", "body"))
        if attributes.rstrip().endswith("/") and tag not in BLOCK:
            return
        mark = self.marks.add(above.mark, (place, marked)) if marked and tag not in ("html", "body") else above.mark
        path = self.known.get((above.path, tag + name)) or self.known.setdefault((above.path, tag + name), self.paths.add(above.path, tag))
        article = above.article or (place if tag in MAIN and not marked else 0)
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append(Open(tag, path, apart, max(above.main, MAIN.get(tag, 0)), mark, article, len(self.stack) if tag in HOLDS_P else above.holds, above.link or tag == "a"))

    def read(self, html: str) -> list[Block]:
        at, end = 0, len(html)
        while at < end:
            m = _TAG.search(html, at)
            self.add(html[at : m.start() if m else end])
            if not m:
                break
            at = m.end()
            closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if tag in BLOCK:
                self.flush()
            if closing:
                self.end(tag)
            elif tag in RAW:
                self.start(tag, attributes + "/", m.start())  # what it closes is closed; it holds no text of the page
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
                at = close.start() if close else end
                if close:
                    at = html.find(">", at) + 1 or end
            elif tag not in VOID:
                self.start(tag, attributes, m.start() + 1)
        self.flush()
        void = _void(self.found, self.marks)
        return [b._replace(apart=b.apart or void[b.mark]) for b in self.found]


def blocks(html: str) -> tuple[list[Block], Tree]:
    """(the blocks of a page in its order, its paths)."""
    reader = Reader()
    return reader.read(html), reader.paths


def _outside(found: list[Block]) -> float:
    """The factor of paths outside of article and main elements: 1 on pages without text in any. A page has one main element, so that little text in it says more than in an article."""
    total = main = article = 0
    for b in found:
        if not b.apart:
            total += len(b.text)
            if b.main == 2:
                main += len(b.text)
            elif b.main:
                article += len(b.text)
    return max(OUTSIDE, ((1 - (main / total) ** 0.125) * (1 - article / total)) ** 2) if main or article else 1.0


def scores(found: list[Block], paths: Tree) -> tuple[dict[int, float], dict[int, bool]]:
    """(fused score of each path's ratios, whether at least half of its text is linked)."""
    outside = _outside(found)
    sums: dict[int, list[float]] = {}
    for b in found:
        if not b.apart:
            s = sums.setdefault(b.path, [0, 0, 0, 0, b.main])
            s[0] += 1
            s[1] += len(b.text)
            s[2] += len(_PUNCTUATION.findall(b.text))
            s[3] += min(b.linked, len(b.text))
    ratio = {p: log1p(n / k) + log1p(marks / k) for p, (k, n, marks, _, _) in sums.items()}
    by_parent: dict[int, list[float]] = {}
    for p, r in ratio.items():
        by_parent.setdefault(paths.parents[p], []).append(r)
    means = {p: sum(x) / len(x) for p, x in by_parent.items()}
    fused = {p: (2 * r + means[paths.parents[p]]) / 3 * (1 - sums[p][3] / sums[p][1]) * (1 if sums[p][4] else outside) for p, r in ratio.items()}
    return fused, {p: 2 * s[3] >= s[1] for p, s in sums.items()}


def selected(found: list[Block], paths: Tree) -> list[str]:
    """Texts of the blocks whose path is content."""
    fused, links = scores(found, paths)
    best = max(fused.values(), default=0)
    own = [b for b in found if not b.apart]
    passed = [fused[b.path] >= CUT * best for b in own]
    beside = [not links[b.path] and any(paths.labels[p] in BESIDE for p in islice(paths.above(b.path), 3)) for b in own]
    for places in (range(1, len(own)), range(len(own) - 2, -1, -1)):
        for k in places:
            near = k - places.step
            if beside[k] and passed[near] and bool(own[k].main) == bool(own[near].main):
                passed[k] = True
    return [b.text for b, p in zip(own, passed, strict=True) if p]


def main_text(html: str | None) -> str:
    return "\n".join(selected(*blocks(html))) if html else ""


@F.arrow_udf(StringType())
def _main_text(html: pa.Array) -> pa.Array:
    return pa.array([main_text(x.as_py()) for x in html], pa.string())


def extract(df: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """df with the main text of each page."""
    return df.withColumn(into, _main_text(F.col(html).cast("string")))
