"""Main text of web pages by composite text density.

Every node of a page's element tree gets a density: characters per tag, times a logarithm that falls
as the share of link characters and link tags grows, compared with the share in the whole body. A
node's density sum is that of its children. The node with the largest sum marks the article; the
smallest density between it and the body is the threshold, and from the body down every
subtree that reaches it gives its own largest-sum node, so an article in several parts is found whole.
What names itself as something else (navigation, aside, form, a class of "ad" or "comments") is taken
out first, and an enclosing ``article`` or ``main`` completes headings and short blocks.

Edge cases: null, empty and tag-only pages give an empty text. Unclosed, stray and unknown tags,
unclosed comments and quotes, and "<" in text never fail. Pages are handled one at a time, in one pass
over the source. Repeated rows and other columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of the HTML language: elements without content, with raw text, and that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg object canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary "
    "table tbody tfoot thead tr ul".split()
)
#: Elements that end an open one of the same family: start tag, what it closes, where the search stops.
CLOSES = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
#: Elements and words in class, id and role that are never the article.
ASIDE = frozenset("nav aside footer form button select fieldset menu dialog head search".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login paywall menu "
    "nav navbar navigation breadcrumb breadcrumbs sidebar rail widget widgets related recommended recommendations "
    "footer masthead share sharing social comment comments commentlist disqus respond reply replies discussion "
    "toolbar pagination pager skip contentinfo complementary".split()
)
#: Parts that a name may have besides: where and in what shape. A name with any other part, such as "related-work", says nothing.
LAYOUT_WORDS = frozenset(
    "left right top bottom center main primary secondary inner outer site page global mobile desktop sticky fixed floating js u l o c "
    "list box container wrapper wrap block section area bar panel slot item items holder unit group column col row content body "
    "link links button buttons icons icon text title form field thread count post posts article articles story stories news "
    "small large big x xs sm md lg xl".split()
)
#: Elements that hold running text: their names do not take them out.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr blockquote pre figcaption caption span a b i em strong code".split())
#: Whole class or id names of page headers.
HEADER_NAMES = frozenset("header site-header page-header global-header top-bar topbar site-title logo".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.DOTALL,
)
_NAMES = re.compile(r"""(?:\s|^)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(
    r"""(?:\s|^)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*(?:display\s*:\s*none|visibility\s*:\s*hidden))""",
    re.IGNORECASE,
)
_WORDS = re.compile(r"[A-Za-z]+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>|\Z", re.IGNORECASE) for t in RAW}


class Page:
    """The element tree as parallel lists; element 0 is the root."""

    def __init__(self, html: str, by_name: bool = True):
        self.by_name = by_name
        self.tag, self.parent, self.aside = ["html"], [-1], [False]
        #: (element, text, starts a block) in page order
        self.runs: list[tuple[int, str, bool]] = []
        #: Open elements by tag, so that an end tag without a start costs nothing.
        self.open: Counter[str] = Counter()
        self._read(html)

    def _close(self, stack: list[int], k: int) -> None:
        """End the elements of the stack from place k on."""
        for e in stack[k:]:
            self.open[self.tag[e]] -= 1
        del stack[k:]

    def _read(self, html: str) -> None:
        stack, pos, fresh, n = [0], 0, True, len(html)
        while pos < n:
            m = _TOKEN.search(html, pos)
            start = m.start() if m else n
            if start > pos:
                self.runs.append((stack[-1], html[pos:start], fresh))
                fresh = False
            if not m:
                break
            pos = m.end()
            closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not name:
                continue
            name = name.lower()
            if name in BLOCK:
                fresh = True
            elif name in ("br", "td", "th"):
                self.runs.append((stack[-1], " ", fresh))
            if closing:
                if self.open[name]:
                    self._close(stack, next(k for k in range(len(stack) - 1, 0, -1) if self.tag[stack[k]] == name))
                continue
            if name in ("html", "body") and name in (self.tag[e] for e in stack[:3]):
                continue
            if name in BLOCK and self.open["p"]:
                k = next(k for k in range(len(stack) - 1, -1, -1) if self.tag[stack[k]] in ("p", "table", "td", "th", "button"))
                if self.tag[stack[k]] == "p":
                    self._close(stack, k)
            if name in CLOSES:
                ends, stops = CLOSES[name]
                while any(self.open[t] for t in ends):
                    k = next(k for k in range(len(stack) - 1, 0, -1) if self.tag[stack[k]] in ends or self.tag[stack[k]] in stops)
                    if self.tag[stack[k]] in stops:
                        break
                    self._close(stack, k)
                    if name != "tr":
                        break
            closed = attributes.endswith("/")
            if name in RAW:
                # HTML knows no empty form of these; only foreign elements have one.
                pos = pos if closed and name == "svg" else _RAW_END[name].search(html, pos).end()
                continue
            if name in VOID:
                continue
            self.tag.append(name)
            self.parent.append(stack[-1])
            self.aside.append(self._is_aside(name, attributes, stack))
            if not closed or name in BLOCK:
                stack.append(len(self.tag) - 1)
                self.open[name] += 1

    def _is_aside(self, name: str, attributes: str, stack: list[int]) -> bool:
        if self.aside[stack[-1]] or name in ASIDE:
            return True
        in_article = self.open["article"] > 0 or self.open["main"] > 0
        if name == "header":
            return not in_article
        if not attributes or name in ("html", "body", "article", "main"):
            return False
        if _HIDDEN.search(attributes):
            return True
        if not self.by_name or name in TEXT_TAGS:
            return False
        for found in _NAMES.findall(attributes):
            for whole in "".join(found).lower().split():
                parts = set(_WORDS.findall(whole))
                if whole in HEADER_NAMES and not in_article:
                    return True
                if parts & ASIDE_WORDS and parts <= ASIDE_WORDS | LAYOUT_WORDS:
                    return True
        return False


def densities(page: Page) -> tuple[list[float], list[float]]:
    """Density and density sum of every element, asides left out."""
    n = len(page.tag)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = page.tag[i] == "a" or in_link[page.parent[i]]
    for i, text, _ in page.runs:
        if not page.aside[i]:
            size = len(text.strip())
            chars[i] += size
            if in_link[i]:
                link_chars[i] += size
    for i in range(n - 1, 0, -1):
        if not page.aside[i]:
            up = page.parent[i]
            chars[up] += chars[i]
            link_chars[up] += link_chars[i]
            tags[up] += tags[i] + 1
            link_tags[up] += link_tags[i] + (page.tag[i] == "a")
    body = next((i for i in range(n) if page.tag[i] == "body"), 0)
    body_ratio = link_chars[body] / max(chars[body], 1)
    own, sums = [0.0] * n, [0.0] * n
    for i in range(n):
        c, t = chars[i], max(tags[i], 1)
        if not c:
            continue
        lc, lt = link_chars[i], max(link_tags[i], 1)
        base = math.log(c / max(c - lc, 1) * lc + body_ratio * c + math.e)
        ratio = c / max(lc, 1) * t / lt
        own[i] = c / t * math.log(max(ratio, 1.0)) / math.log(base) if base > 1.0001 else c / t * math.log(max(ratio, 1.0) + 1)
        if i:
            sums[page.parent[i]] += own[i]
    return own, sums


def content(page: Page) -> list[bool]:
    """Which elements belong to the article."""
    n = len(page.tag)
    own, sums = densities(page)
    best, at = sums[:], list(range(n))
    for i in range(n):
        if not sums[i]:
            best[i] = own[i]
    for i in range(n - 1, 0, -1):
        up = page.parent[i]
        if best[i] > best[up] and not page.aside[i]:
            best[up], at[up] = best[i], at[i]
    body = next((i for i in range(n) if page.tag[i] == "body"), 0)
    top = at[body]
    path, i = [top], top
    while i != body and page.parent[i] >= 0:
        i = page.parent[i]
        path.append(i)
    threshold = min(own[i] for i in path)
    marked, reached = [False] * n, [False] * n
    reached[body] = True
    for i in range(body, n):
        if i != body:
            reached[i] = reached[page.parent[i]] and own[i] >= threshold and not page.aside[i]
        if reached[i] and own[i] > 0 and i != body:
            marked[at[i]] = True
    marked[top] = True
    for i in range(n):
        if marked[i]:
            whole = i
            while whole > 0:
                if page.tag[whole] in ("article", "main"):
                    marked[whole] = True
                whole = page.parent[whole]
    for i in range(1, n):
        marked[i] = (marked[i] or marked[page.parent[i]]) and not page.aside[i]
    return marked


def main_text(html: str | None) -> str:
    """The article's blocks, joined by an empty line."""
    if not html:
        return ""
    return _joined(Page(html)) or _joined(Page(html, by_name=False))


def _joined(page: Page) -> str:
    keep = content(page)
    blocks, current = [], []
    for element, text, fresh in page.runs:
        if fresh and current:
            blocks.append("".join(current))
            current = []
        if keep[element]:
            current.append(text)
    blocks.append("".join(current))
    clean = (" ".join(unescape(b).split()) for b in blocks)
    return "\n\n".join(b for b in clean if b)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column("html")]
        columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())]
        columns.append(pa.array(map(len, texts), pa.int64()))
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page; a map without a shuffle."""
    types = {f.name: f.dataType.simpleString() for f in pages.schema}
    rows = pages.select("page_id", "url", "html")
    return rows.mapInArrow(_extract, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
