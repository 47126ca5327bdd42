"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with its root-to-leaf tag path (with
classes and ids, without inline tags). For every path the text length, the
punctuation and the linked text of all its blocks are added up, so a one-word
paragraph shares the fate of the other paragraphs. A path's ratio is its text per
block times its punctuation per block, both damped, less its share of links.
Ratios are smoothed over paths with the same container (weighted by text), fused
with the path's own, and paths above a share of the page's text-weighted mean are
content (that of the text that no name marks, if it is higher: long comments don't lower it). Parts of lists, tables and figures (``PARTS``) are also smoothed over the
paths around the whole list, table or figure, less their links. Text of an article
element (of a main element where no article has any) with no such name of its own is
content whatever its ratio: short items, cells and captions are the article's too.

Elements that HTML itself marks as something else (navigation, scripts, hidden ones, ...)
are not content. Names in a class, id or role, and forms, only weigh: the fused ratio
of a path counts for ``NAMED`` with every element of such a name around it. Names may
also belong to a wrapper of the whole page (``has-sidebar``), so those around the page's
text do not count: its *home* is where, at the least such depth with more than ``HOME`` of
the page's text, most of it stands.

A page is worked on in one pass over its tags and one over its blocks, in Python
on the executors, in time that follows its length at any depth of nesting and for unclosed
tags and quotes; the plan is a scan and one Arrow map.

Cases: null, empty and text-free pages give an empty text. Unclosed and stray tags
are closed as browsers do for paragraphs, list items and table cells, and ignored
else. Character references are decoded once; any white space within a block is one
space; ``<br>`` is white space. Repeated rows, long pages, empty tables and further
columns are handled alike.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of the page's mean that a path's ratio must reach.
THRESHOLD = 0.25
#: Weight of a path's own ratio against that of its container's other paths.
OWN = 0.4
#: How much more a path within an article or main element counts.
MARKED = 8.0

#: What a path's ratio counts for with every name around it that marks something else.
NAMED = 0.1
#: Least share of the page's text without links at the depth of its home.
HOME = 0.02

_START = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--|!\[CDATA\[|[!?]))")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAMED = frozenset(("class", "id", "role", "itemprop"))
_HIDING = frozenset(("hidden", "aria-hidden", "style"))
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[,.;:!?…，。；：！？、«»„“”]")
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas audio video select".split())
ASIDE = frozenset("nav header footer aside form menu dialog button fieldset head".split())
#: Words in a class, id or role that mark something else than the article.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies copyright disqus discussion footer "
    "gdpr header login masthead menu modal nav navbar navigation newsletter notice overlay pagination pager paywall popup promo promotion related remark remarks replies respond share sharing sidebar signup "
    "skip social sponsor sponsored subscribe subscription tags toolbar widget widgets".split()
)
#: Start tags that end an open element of these names (within its own list or table).
ENDS = {
    **{t: ({"p"}, frozenset()) for t in "address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()},
    "li": ({"li", "p"}, frozenset(("ul", "ol", "menu"))),
    "dt": ({"dt", "dd", "p"}, frozenset(("dl",))),
    "dd": ({"dt", "dd", "p"}, frozenset(("dl",))),
    "tr": ({"tr", "td", "th", "p"}, frozenset(("table",))),
    "td": ({"td", "th", "p"}, frozenset(("tr", "table"))),
    "th": ({"td", "th", "p"}, frozenset(("tr", "table"))),
    "option": ({"option"}, frozenset(("select",))),
}
#: Elements that mark the article, the closest mark highest.
MARKS = {"main": 1, "article": 2}
#: Elements that only weigh, as names do.
SOFT = frozenset(("form", "fieldset"))
PARTS = frozenset("li ul ol dl dt dd table thead tbody tfoot tr td th caption figure figcaption".split())


_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}


def _tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(begin, end, closing, name, attributes) of every tag; comments and declarations have no name.

    A quoted ``>`` does not end a tag, unless its quote is never closed.
    """
    at, quotes = 0, True
    while m := _START.search(page, at):
        at = m.end()
        if m[3]:
            close = {"!--": "-->", "![CDATA[": "]]>"}.get(m[3], ">")
            end = page.find(close, at)
            if end < 0 and close == ">":
                return
            at = len(page) if end < 0 else end + len(close)
            yield m.start(), at, False, "", ""
            continue
        end, i = -1, at
        while quotes:
            stop = _STOP.search(page, i)
            if stop is None:
                quotes = False
            elif stop[0] == ">":
                end = stop.start()
                break
            elif (i := page.find(stop[0], stop.end()) + 1) == 0:
                quotes = False
        if end < 0:
            end = page.find(">", at)
            if end < 0:
                return
        name, begin = m[2].lower(), m.start()
        yield begin, end + 1, bool(m[1]), name, page[at:end]
        at = end + 1
        if name in RAW and not m[1] and not (page[end - 1] == "/" and name in ("svg", "math")):
            close = _END[name].search(page, at)
            at = len(page) if close is None else close.start()
            yield begin, at, False, "", ""  # what it holds is no text


class _Block:
    __slots__ = ("path", "parts", "linked", "marked", "bar")

    def __init__(self, path: int, marked: int, bar: int):
        self.path, self.parts, self.linked, self.marked, self.bar = path, [], 0, marked, bar


#: The bar of an element that is never content.
HARD = -1


class Page:
    """Blocks of text in page order; paths and bars (names that mark something else) are chains of numbers."""

    def __init__(self, page: str):
        self.blocks: list[_Block] = []
        self.paths: dict[tuple[int, str], int] = {}
        self.above, self.label = [0], [""]  # of a path
        self.bar_above, self.bar_depth = [0], [0]  # of a bar; 0 is none
        self._read(page)

    def _path(self, above: int, label: str) -> int:
        key = (above, label)
        if key not in self.paths:
            self.paths[key] = len(self.above)
            self.above.append(above)
            self.label.append(label)
        return self.paths[key]

    def _read(self, page: str) -> None:
        # Open elements: name, path, mark, bar. Links are counted apart.
        stack: list[tuple[str, int, int, int]] = [("", 0, 0, 0)]
        opened: dict[str, int] = {}
        links, block, at = 0, None, 0

        def add(text: str) -> None:
            nonlocal block
            if not text or block is None and text.isspace():
                return
            if block is None:
                block = _Block(*stack[-1][1:])
                self.blocks.append(block)
            block.parts.append(text)
            if links:
                block.linked += len(text)

        def pop(size: int) -> None:
            for e in stack[size:]:
                opened[e[0]] -= 1
            del stack[size:]

        for begin, end, closing, name, attributes in _tags(page):
            if begin >= at:
                add(page[at:begin])
            at = end
            if not name:
                continue
            if closing:
                if name == "a":
                    links = 0
                elif name in INLINE or name in RAW:
                    pass
                elif opened.get(name):
                    size = len(stack) - 1
                    while stack[size][0] != name:
                        size -= 1
                    pop(size)
                    block = None
                elif name == "p":
                    block = None
                continue
            if name == "br":
                add(" ")
                continue
            if name == "a":
                links = 1
                continue
            if name in INLINE or name in RAW:
                continue
            if name in VOID:
                if name == "hr":
                    block = None
                continue
            if name in ENDS:
                names, scope = ENDS[name]
                size = len(stack)
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in names:
                        size = k
                    elif stack[k][0] in scope or not scope:
                        break
                    if not any(opened.get(n, 0) for n in names):
                        break
                pop(size)
            links = 0
            _, path, above, bar = stack[-1]
            own, soft, hard, label = MARKS.get(name, 0), name in SOFT, False, name
            if attributes.strip(" /"):
                words: set[str] = set()
                for m in _ATTRIBUTE.finditer(attributes):
                    key = m[1].lower()
                    if key not in _NAMED and key not in _HIDING:
                        continue
                    value = m[2] or m[3] or m[4] or ""
                    if key in _HIDING:
                        hard = hard or key == "hidden" or key == "aria-hidden" and value.strip().lower() == "true" or key == "style" and bool(_UNSEEN.search(value))
                        continue
                    words.update(w for w in _SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()) if w)
                    if key in ("class", "id"):
                        label += "." + re.sub(r"\d+", "", value)
                    if "articlebody" in value.lower():
                        own = 2
                    elif "main" in words and key == "role":
                        own = max(own, 1)
                if name not in ("html", "body", *MARKS):
                    soft = soft or bool(words & ASIDE_WORDS)
                else:
                    hard = False
            marked = max(above, own)
            if bar == HARD or hard or (name in ASIDE and name not in SOFT and not (name == "header" and marked)):
                bar = HARD
            elif soft:
                self.bar_above.append(bar)
                self.bar_depth.append(self.bar_depth[bar] + 1)
                bar = len(self.bar_above) - 1
            stack.append((name, self._path(path, label), marked, bar))
            opened[name] = opened.get(name, 0) + 1
            block = None
        add(page[at:])


def _home(bars: dict[int, int], depth: list[int]) -> int:
    """The bar of the page's text: of the least depth that holds a share of it, the one with most."""
    total = sum(bars.values())
    by_depth: dict[int, int] = {}
    for b, n in bars.items():
        by_depth[depth[b]] = by_depth.get(depth[b], 0) + n
    least = min((d for d, n in by_depth.items() if n > HOME * total), default=0)
    return max((b for b in bars if depth[b] == least), key=lambda b: (bars[b], -b), default=0)


def extract(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    read = Page(page)
    found, bars = [], {}
    for b in read.blocks:
        text = _SPACE.sub(" ", html.unescape("".join(b.parts))).strip() if b.bar != HARD else ""
        if text:
            found.append((b, text))
            if len(text) > 2 * b.linked:
                bars[b.bar] = bars.get(b.bar, 0) + len(text) - b.linked
    if not found:
        return ""
    if not bars:  # nothing but links: what a name marks is not content
        found = [(b, text) for b, text in found if not b.bar]
        if not found:
            return ""
    home = _home(bars, read.bar_depth)
    excess = {}
    while home:
        excess[home] = 0
        home = read.bar_above[home]
    excess[0] = 0
    for b in range(1, len(read.bar_above)):  # a bar comes after the one around it
        if b not in excess:
            excess[b] = excess[read.bar_above[b]] + 1

    sums: dict[int, list[float]] = {}
    for b, text in found:
        s = sums.setdefault(b.path, [0, 0, 0, 0, 1.0, 1.0])
        s[0] += 1
        s[1] += len(text)
        s[2] += len(_PUNCTUATION.findall(text))
        s[3] += min(b.linked, len(text))
        s[4] = MARKED if b.marked and not excess[b.bar] else 1.0
        s[5] = min(s[5], NAMED ** excess[b.bar])
    ratio = {p: math.log1p(length / n) * (0.25 + math.log1p(marks / n)) * max(0.0, 1 - linked / length) * weight for p, (n, length, marks, linked, weight, _) in sums.items()}
    around: dict[int, list[float]] = {}
    for p, s in sums.items():
        a = around.setdefault(read.above[p], [0.0, 0.0])
        a[0] += s[1] * ratio[p]
        a[1] += s[1]

    def surroundings(p: int) -> float:
        near = around[read.above[p]][0] / around[read.above[p]][1]
        end = p
        while end and read.label[end].split(".", 1)[0] in PARTS:
            end = read.above[end]
        if end != p and end in around:
            far = around[end]
            near = max(near, far[0] / far[1] * (1 - sums[p][3] / sums[p][1]))
        return near

    fused = {p: (OWN * r + (1 - OWN) * surroundings(p)) * sums[p][5] for p, r in ratio.items()}
    top = max((b.marked for b, _ in found if not excess[b.bar]), default=0)
    mean = max(_mean(sums, fused), _mean({p: s for p, s in sums.items() if s[5] == 1.0}, fused))
    return "\n".join(text for b, text in found if (b.marked and b.marked == top and not excess[b.bar]) or fused[b.path] >= max(THRESHOLD * mean, 1e-9))


def _mean(sums: dict[int, list[float]], fused: dict[int, float]) -> float:
    """Mean of the fused ratios of some paths, weighted by their text."""
    return sum(s[1] * fused[p] for p, s in sums.items()) / max(1, sum(s[1] for s in sums.values()))


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", carry: Sequence[str] = ("url",)) -> DataFrame:
    """``id_col, *carry, text, n_chars`` of every row of ``pages``."""
    narrow = pages.select(F.col(id_col).alias("_id"), *(F.col(c).alias(f"_carry{i}") for i, c in enumerate(carry)), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [extract(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*batch.schema.names[:-1], "_text", "_n"])

    shapes = ", ".join(f"{c} {narrow.schema[c].dataType.simpleString()}" for c in narrow.columns[:-1])
    out = narrow.mapInArrow(run, f"{shapes}, _text string, _n long")
    return out.select(F.col("_id").alias(id_col), *(F.col(f"_carry{i}").alias(c) for i, c in enumerate(carry)), F.col("_text").alias("text"), F.col("_n").alias("n_chars"))
