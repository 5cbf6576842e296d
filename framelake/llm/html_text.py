"""Main text of web pages by line-block distribution.

Markup is stripped first: each block element of a page becomes one line of text, in page order.
Lines in menus, headers, footers, sidebars, notices, adverts, forms and comments (by element, role,
class or id), scripts and styles keep their place but count as empty; so do, outside a marked article,
lines that are links for the most part. Names count on containers, and inside a marked article only
if nothing in a name says otherwise (`ad-slot` is an advert, `social-history` is a section); on
paragraphs only a class counts, on headings nothing. The weight of a line is its text's length, and `MARKED`
times that in an element that the page marks as its article (`article`, or else `main`). The sum of
`window` lines from each line on is the block distribution: it surges where the article starts and dives to
nothing where it ends. The text between a surge and the next dive is a candidate. If most of the weightiest
candidate is marked, the mark gives its exact ends, and all lines in the mark are kept, however short; a mark around
a teaser only is passed over. Otherwise candidates that hold at least a share of the weightiest one
are kept: an article cut by a long advert stays whole. So are all lines in the container of its longest line,
however short their run.

Null and empty pages, and pages without text, give an empty text. Repeated rows each give a row.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW = 3
#: A surge needs this many characters in a window, or the page's best window if that is less.
SURGE = 80
#: Candidates with less than this share of the longest one's text are left out.
SHARE = 0.2
#: A line in a marked article weighs as much as so many outside.
MARKED = 4
#: Above this share of linked text, a line is a menu.
LINKED = 0.7

#: A comment, a declaration or a tag; quantifiers are possessive, so unclosed quotes cost no retries.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>?", re.S
)
_RAW = ("script", "style", "noscript", "template", "textarea", "svg", "iframe", "object", "math", "title", "select")
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*>?", re.I) for name in _RAW}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
_APART = frozenset("nav header footer aside form button dialog menu head fieldset".split())
#: An article in one of these is never the page's.
_BESIDE = frozenset("nav footer aside dialog menu".split())
_ATTRIBUTE = re.compile(r"([^\s=\"'/]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"']++))?+")
#: Elements that hold one paragraph; a container holds several.
_PARAGRAPH = frozenset("p li dt dd td th tr h1 h2 h3 h4 h5 h6 pre blockquote figcaption caption summary address".split())
_NAME = (
    r"nav|navbar|navigation|menu|header|masthead|footer|sidebar|aside|ads?|advert\w*|adsense|sponsor\w*|promo\w*|"
    r"banner|cookies?|consent|notice|alert|popup|modal|overlay|comments?|disqus|respond|replies|reply|share|sharing|social|related|"
    r"recommend\w*|breadcrumbs?|newsletter|subscribe|signup|login|search|widget|complementary|contentinfo|form"
)
_NAMES = re.compile(rf"(?:^|[\s_-])(?:{_NAME})(?:$|[\s_-])", re.I)
#: Words that go with a name without changing what it means.
_LAYOUT = (
    r"area|articles?|bar|block|bottom|box|btns?|buttons?|container|content|icons?|inner|inline|items?|left|links?|list|main|"
    r"page|panel|posts?|right|section|site|slot|small|stories|thread|title|toolbar|top|unit|wrap(?:per)?|\d+"
)
_WHOLE_NAME = re.compile(rf"(?:(?:{_LAYOUT})[_-]+)*(?:{_NAME})(?:[_-]+(?:{_NAME}|{_LAYOUT}))*", re.I)
_HEADING = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_ASIDE_ARTICLE = re.compile(r"(?:^|[\s_-])(?:comments?|reply|replies|related|promo|advert\w*)(?:$|[\s_-])", re.I)
_UNSHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
#: These start a new element of their kind where one is open: their end tags may be left out.
_CLOSED_BY = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


def _boilerplate(name: str, attributes: str, marked: bool) -> bool:
    if name in _APART:
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    own: dict[str, str] = {}
    for key, value in _ATTRIBUTE.findall(attributes):
        own.setdefault(key.lower(), html.unescape(value[1:-1] if value[:1] in ("'", '"') else value))
    if "hidden" in own or own.get("aria-hidden", "").lower() == "true" or _UNSHOWN.search(own.get("style", "")):
        return True
    if "hidden" in own.get("class", "").lower().split():
        return True
    if name in _HEADING:
        return False
    if name in _PARAGRAPH or marked and name != "article":
        keys = ("class",) if name in _PARAGRAPH else ("class", "id", "role")
        return any(_WHOLE_NAME.fullmatch(word) for key in keys for word in own.get(key, "").split())
    names = _ASIDE_ARTICLE if name == "article" else _NAMES
    return any(names.search(own[key]) for key in ("class", "id", "role") if key in own)


class _Page:
    """Lines of a page, and for each its linked length and whether it lies in an article, in main, or apart."""

    def __init__(self) -> None:
        self.lines: list[tuple[str, int, bool, bool, bool]] = []
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.open: list[tuple[str, bool, int]] = []  # name, whether it is set apart, its first line
        self.spans: list[tuple[int, int]] = []  # first line and end of each container
        self.bare: list[int] = []  # lines outside containers
        self.depth = 0
        self.count = dict.fromkeys(("apart", "article", "main", "a"), 0)
        self.marked = False

    def text(self, raw: str) -> None:
        self.parts.append(raw)
        if self.count["a"]:
            self.linked.append(raw)

    def line(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            linked = len(" ".join(html.unescape(" ".join(self.linked)).split())) if self.linked else 0
            self.lines.append((text, linked, self.count["article"] > 0, self.count["main"] > 0, self.count["apart"] > 0))
            if not self.depth:
                self.bare.append(len(self.lines) - 1)
            self.parts, self.linked = [], []

    def start(self, name: str, attributes: str) -> None:
        apart = _boilerplate(name, attributes, self.count["article"] + self.count["main"] > 0)
        if name not in _INLINE or apart:
            self.line()
        beside = any(above in _BESIDE for above, _, _ in self.open) if name in ("article", "main") else True
        if not beside and not apart and not self.marked:
            # what holds the page's article isn't boilerplate, whatever its name
            self.marked = True
            self.open = [(above, False, low) for above, _, low in self.open]
            self.count["apart"] = 0
        for i in range(len(self.open) - 1, -1, -1) if name in _CLOSED_BY else ():
            if self.open[i][0] in _CLOSED_BY[name]:
                self._close(i)
                break
            if self.open[i][0] not in _INLINE:
                break
        if name in _VOID or attributes.endswith("/"):
            return
        self.open.append((name, apart, len(self.lines)))
        self._count(name, apart, 1)

    def end(self, name: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == name:
                if name not in _INLINE or self.open[i][1]:
                    self.line()
                self._close(i)
                return
            if name in _INLINE and self.open[i][0] not in _INLINE:
                return  # a stray end tag
        if name not in _INLINE:
            self.line()

    def _close(self, i: int) -> None:
        for name, apart, low in self.open[i:]:
            self._count(name, apart, -1)
            if _container(name):
                self.spans.append((low, len(self.lines)))
        del self.open[i:]

    def _count(self, name: str, apart: bool, by: int) -> None:
        self.count["apart"] += by * apart
        self.depth += by * _container(name)
        if name in self.count and name != "apart":
            self.count[name] += by


def _container(name: str) -> bool:
    return name not in _INLINE and name not in _PARAGRAPH and name not in ("html", "body")


def read_page(page: str) -> _Page:
    out, at = _Page(), 0
    while True:
        tag = _TAG.search(page, at)
        if not tag:
            out.text(page[at:])
            out.line()
            out._close(0)
            return out
        if tag.start() > at:
            out.text(page[at : tag.start()])
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if tag[1]:
            out.end(name)
        elif name in _RAW:
            close = _RAW_END[name].search(page, at) if not tag[3].endswith("/") else None
            at = close.end() if close else (at if tag[3].endswith("/") else len(page))
        else:
            out.start(name, tag[3])


def candidates(weights: list[float], window: int = WINDOW, surge: float = SURGE) -> list[tuple[float, int, int]]:
    """(weight, first line, end) between each surge and dive of the block distribution."""
    n = len(weights)
    sums, filled = [0.0] * n, [False] * n
    for i in range(n):
        block = weights[i : i + window]
        sums[i], filled[i] = sum(block), any(block)
    needed = min(surge, max(sums, default=0))
    runs, i = [], 0
    while i < n:
        if not filled[i]:
            i += 1
            continue
        end = i
        while end < n and filled[end]:  # the dive: a whole window is empty
            end += 1
        if max(sums[i:end]) >= needed:
            runs.append((sum(weights[i:end]), i, end))
        i = end
    return runs


def kept_lines(weights: list[float], window: int = WINDOW, surge: float = SURGE, share: float = SHARE) -> list[bool]:
    """Lines between the surges and the dives of the block distribution."""
    runs = candidates(weights, window, surge)
    most = max((weight for weight, _, _ in runs), default=0)
    keep = [False] * len(weights)
    for weight, low, high in runs:
        if weight >= share * most:
            keep[low:high] = [w > 0 for w in weights[low:high]]
    return keep


def container_lines(page: _Page, lengths: list[int], keep: list[bool]) -> list[bool]:
    """keep, and the lines in the smallest container of the longest line that it keeps."""
    if True not in keep:
        return keep
    longest = max((i for i, kept in enumerate(keep) if kept), key=lambda i: lengths[i])
    around = [span for span in page.spans if span[0] <= longest < span[1]]
    low, high = min(around, key=lambda span: span[1] - span[0], default=(0, 0))
    same = range(low, high) if around else page.bare
    keep = list(keep)
    for i in same:
        keep[i] = lengths[i] > 0
    return keep


def main_text(page: str | None) -> str:
    read = read_page(page or "")
    lines = read.lines
    for mark in (2, 3):  # article, or else main
        lengths = [
            0 if line[4] or not line[mark] and line[1] > LINKED * len(line[0]) else len(line[0]) for line in lines
        ]
        weights = [MARKED * n if line[mark] else n for line, n in zip(lines, lengths)]
        weight, low, high = max(candidates(weights), key=lambda run: run[0], default=(0, 0, 0))
        marked = sum(w for line, w in zip(lines[low:high], weights[low:high]) if line[mark])
        if weight and 2 * marked >= weight:
            keep = [n > 0 and line[mark] for line, n in zip(lines, lengths)]
            break
    else:
        lengths = [0 if line[4] or line[1] > LINKED * len(line[0]) else len(line[0]) for line in lines]
        keep = container_lines(read, lengths, kept_lines(lengths))
    return " ".join(line[0] for line, kept in zip(lines, keep) if kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page.as_py()) for page in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars; one row for each page."""
    return pages.select("page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
