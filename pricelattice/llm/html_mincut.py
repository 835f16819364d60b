"""Main text of web pages by minimum-cut labelling.

A page becomes a sequence of text blocks. A linear classifier turns each block's tags, class names,
link share and length into a log-odds of being content: the capacity of its edge from the source
(content) or to the sink (boilerplate). Blocks in a row, and blocks in a row under one parent, are
joined by smoothness edges. The minimum cut is the labelling of least total cost: what the source
still reaches in the residual graph is content.
"""

from __future__ import annotations

import html
import re
from collections import deque
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A comment, declaration or tag. Nothing in it is tried twice, and one that never ends takes the rest of the
#: page, as in browsers, so that a page is read in linear time.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?)*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

#: Tags by what they mean for blocks.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "select", "math"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
    "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
}
CLOSED_BY_BLOCK = {"p"}
ONE_OF = {"li": {"ul", "ol", "menu"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
#: Elements that close each other.
TWIN = {"td": "th", "th": "td", "dt": "dd", "dd": "dt"}
BOILERPLATE_TAGS = {"nav", "footer", "aside", "form", "dialog", "menu", "button", "fieldset"}
#: Names of boilerplate; names of link lists, which a text may be about as well; weaker names; names of content.
SURE = re.compile(
    r"ads?|advert\w*|breadcrumbs?|comments?|cookies?|consent|disqus|footer|gdpr|nav|navbar|navigation|newsletter|pagination|sidebar|sponsor\w*|"
    r"subscribe|complementary|contentinfo"
)
LINKY = re.compile(r"related|share|sharing|social")
HINT = re.compile(
    r"banner|copyright|disclaimer|foot|header|legal|login|masthead|menu|modal|notice|pager|popup|promo\w*|recommend\w*|replies|"
    r"side|signup|tags?|toolbar|topbar|widget|alert"
)
CONTENT = re.compile(r"article|content|entry|main|post|story|body")
#: Parts of a compound that name a place or a container, so that the other parts say what it holds.
FRAME = re.compile(
    r"site|page|global|top|bottom|left|right|inner|outer|wrap|wrapper|container|box|bar|block|list|item|items|area|section|panel|row|col|column|"
    r"group|links?|buttons?|icons?|form|thread|feed|media|slot|unit|zone|new|user|reader|primary|secondary|the|js|ul|li|div|\d*|[a-z]"
)
_PIECES = re.compile(r"[\W_]+|(?<=[a-z])(?=[A-Z])")

#: Log-odds of the classifier.
IN_ARTICLE, BAD_TAG, BAD_NAME, HINT_NAME, GOOD_NAME = 4.0, -9.0, -8.0, -3.0, 2.0
#: For short blocks and links under a name of link lists.
LINKY_NAME = -6.0
#: For the blocks of a page without an article or main element.
NO_ARTICLE = 1.0
PARAGRAPH, HEADING, LONG_TEXT, SHORT_TEXT, LINKS = 1.5, 0.5, 1.5, -0.75, -4.0
#: Cost of a change of label between blocks in a row, and more if they share a parent.
NEXT, SIBLING = 0.4, 0.8


@dataclass
class Block:
    text: str
    parent: int
    score: float
    in_article: bool


def _collapse(parts: list[str]) -> str:
    return " ".join(html.unescape("".join(parts)).split())


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order. Comments, scripts, styles, the head's title and the like hold
    no blocks. Tags that are never closed are closed by their surroundings, as browsers do."""
    out: list[Block] = []
    stack: list[tuple[str, int, float, bool, bool]] = [("", 0, 0.0, False, False)]  # tag, number, log-odds, in an article, under a name of link lists
    places: dict[str, list[int]] = {}  # of the open elements of each tag in the stack, outermost first
    parts: list[str] = []
    linked = opened = 0
    in_link = 0

    def inmost(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _collapse(parts)
            if text:
                out.append(_scored(text, linked, stack))
            parts.clear()
        linked = 0

    def close(k: int) -> None:
        flush()
        for tag, *_ in stack[k:]:
            places[tag].pop()
        del stack[k:]

    at, end = 0, len(page)
    while at < end:
        tag = _TAG.search(page, at)
        stop = tag.start() if tag else end
        if stop > at:
            parts.append(page[at:stop])
            if in_link:
                linked += stop - at
        if not tag:
            break
        at = tag.end()
        if not tag[2]:
            continue
        name = tag[2].lower()
        if name in RAW:
            if not tag[1] and not tag[3].endswith("/"):
                closing = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                if not closing:
                    break
                at = closing.end()
            continue
        if name in ("br", "wbr"):
            parts.append(" " if name == "br" else "")
        elif name in INLINE:
            if name == "a":
                in_link = max(0, in_link - 1) if tag[1] else 1
        elif name in VOID:
            flush()
        elif tag[1]:
            if own := inmost([name]):
                close(own)
            else:
                flush()
            in_link = 0
        else:
            if stack[-1][0] in CLOSED_BY_BLOCK:
                close(len(stack) - 1)
            if name in ONE_OF:
                same = inmost([name, TWIN.get(name, name)])
                if same > inmost(ONE_OF[name]):
                    close(same)
            flush()
            opened += 1
            places.setdefault(name, []).append(len(stack))
            stack.append((name, opened, *_context(name, tag[3], stack[-1])))
    flush()
    return out


def _named(names: str) -> tuple[float, bool]:
    """Log-odds of class names, ids and roles, and whether one is a name of link lists. A listed word counts in full where it is the whole
    name or the rest of a compound only names a place (`comment-list`); in other compounds (`social-history`) it is a hint."""
    odds, linky, good = 0.0, False, False
    for name in names.split():
        parts = [p.lower() for p in _PIECES.split(name) if p]
        sure = [p for p in parts if SURE.fullmatch(p)]
        links = [p for p in parts if LINKY.fullmatch(p)]
        hints = [p for p in parts if HINT.fullmatch(p)]
        rest = [p for p in parts if p not in sure and p not in links and p not in hints and not CONTENT.fullmatch(p) and not FRAME.fullmatch(p)]
        if (sure and not rest) or (len(parts) == 1 and hints):
            odds = BAD_NAME
        elif sure or links or hints:
            odds, linky = min(odds, HINT_NAME), linky or (bool(links) and not rest)
        good = good or any(CONTENT.fullmatch(p) for p in parts)
    return odds or (GOOD_NAME if good else 0.0), linky


def _context(name: str, attributes: str, around: tuple[str, int, float, bool, bool]) -> tuple[float, bool, bool]:
    """Log-odds that an element hands down to its blocks, and whether it is in an article and under a name of link lists."""
    _, _, odds, article, linky = around
    names = " ".join(next(filter(None, m.groups()[1:]), "") for m in _ATTRIBUTE.finditer(attributes)) if "=" in attributes else ""
    if name in ("article", "main") and not article:
        odds, article = odds + IN_ARTICLE, True
    if name in BOILERPLATE_TAGS or (name == "header" and not article) or name == "head":
        odds += BAD_TAG
    if names and name not in ("html", "body"):
        own, listed = _named(names)
        odds, linky = odds + own, linky or listed
    return odds, article, linky


def _scored(text: str, linked: int, stack: list) -> Block:
    tag, number, odds, article, linky = stack[-1]
    words = text.count(" ") + 1
    parent = stack[-2][1] if len(stack) > 1 else 0
    odds += PARAGRAPH if tag in ("p", "pre", "blockquote", "td", "dd") else HEADING if re.fullmatch("h[1-6]", tag) else 0
    odds += LONG_TEXT if words >= 20 else SHORT_TEXT if words < 6 and not article else 0
    if linked > 0.5 * len(text):
        odds += LINKS if not article else LINKS / 2
    if linky and (words < 10 or linked > 0.5 * len(text)):
        odds += LINKY_NAME
    return Block(text, parent, odds, article)


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: a node labelled False pays its positive score, one labelled True pays
    its negative score, an edge with two labels pays its weight. Maximum flow by Dinic's method;
    True is what the source reaches in the residual graph."""
    n = len(scores)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(there)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for k, score in enumerate(scores):
        if score > 0:
            join(source, k, score, 0.0)
        elif score < 0:
            join(k, sink, -score, 0.0)
    for a, b, w in edges:
        join(a, b, w, w)
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > 1e-12 and to[e] not in level:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if sink not in level:
            return [k in level for k in range(n)]
        step = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if room[e] <= 1e-12)
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while step[a] < len(out[a]):
                e = out[a][step[a]]
                if room[e] > 1e-12 and level.get(to[e]) == level[a] + 1:
                    path.append(e)
                    a = to[e]
                    break
                step[a] += 1
            else:
                if a == source:
                    break
                a = to[path.pop() ^ 1]
                step[a] += 1


def labelled(page: str) -> list[tuple[Block, bool]]:
    """Blocks of a page and whether each is content."""
    found = blocks(page)
    if not any(b.in_article for b in found):
        for b in found:
            b.score += NO_ARTICLE
    edges = [(k, k + 1, NEXT + (SIBLING if a.parent == b.parent else 0)) for k, (a, b) in enumerate(zip(found, found[1:]))]
    last: dict[int, int] = {}
    for k, b in enumerate(found):
        if last.get(b.parent, k - 1) < k - 1:
            edges.append((last[b.parent], k, SIBLING))
        last[b.parent] = k
    return list(zip(found, min_cut([b.score for b in found], edges), strict=True))


def main_text(page: str | None) -> str:
    return " ".join(b.text for b, content in labelled(page or "") if content)


@F.pandas_udf(T.StringType())
def _main_text(pages: pd.Series) -> pd.Series:
    return pages.map(main_text, na_action=None)


def extract(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """Add ``out``, the main text of ``html_col``, and ``n_chars``, its code points.

    A null or empty page has the empty text. Character references are decoded, white space inside a
    block is one space, blocks are joined by one space. Pages may be of any length and cut off
    anywhere; repeated rows give repeated results. Other columns stay; ``out`` and ``n_chars`` are
    replaced if there."""
    return pages.withColumn(out, _main_text(html_col)).withColumn("n_chars", F.length(out).cast("long"))
