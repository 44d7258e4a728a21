"""Main text of web pages: parser events, text-to-tag ratio per line, smoothing, clusters.

The library's own records are words on printed pages; uploads saved as web pages are none of them. So this operator
is general: it takes any table with an ``html`` column.

The standard library's parser turns a page into lines, one per block element, with their text and number of tags.
What stands in menus, forms, notices, adverts and the like is left out, so their lines are empty. The ratio of text to tags is smoothed along the
page with a Gaussian; lines whose smoothed ratio reaches the threshold form clusters. These only show where the content
is: a cluster inside an ``article`` or ``main`` element stands for the whole element, and without such elements the
clusters stand for the smallest element around all their dense lines, however short its other lines are.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that break lines.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre "
    "search section select summary table tbody td template textarea tfoot th thead title tr ul".split()
)
#: Elements without content, which are never closed.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never part of an article.
ASIDE = frozenset(
    "aside button canvas datalist dialog footer form head iframe input menu nav noscript object option script search "
    "select style svg template textarea title".split()
)
REGIONS = frozenset(("article", "main"))
#: Words in class, id and role that mark such parts.
MARKS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments "
    "commentlist consent contentinfo cookie cookies copyright disclaimer disqus footer gdpr login masthead menu modal nav "
    "navbar navigation newsletter notice overlay pagination paywall popup promo promotion recommended related replies "
    "reply search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Before such a word in the same class, these say what a wrapper has or lacks, not what it is.
WITH = frozenset("has have hide no non not show with without".split())
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
#: An opening tag of the key closes an open element of the values.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",),
}
#: Elements that end an open paragraph.
ENDS_P = BLOCKS - frozenset("body html head td th tr tbody thead tfoot caption option optgroup".split())
#: Elements that are the page itself.
PAGE = frozenset(("html", "body"))
SIGMA = 1.0


@dataclass(slots=True)
class Line:
    text: str
    tags: int
    region: int | None
    #: Number of the innermost open element, and whether all text stands in links.
    element: int
    linked: bool


class LineEvents(HTMLParser):
    """Collects the lines of a page from the parser's events."""

    def __init__(self, marks: bool = True) -> None:
        super().__init__(convert_charrefs=True)
        self.marks = marks
        self.lines: list[Line] = []
        #: (tag, part of an aside, number of the region, of the element, within a link, aside by its class only)
        self.open: list[tuple[str, bool, int | None, int, bool, bool]] = []
        #: Parent and tag of each element by number; 0 is the page.
        self.parents, self.names = [0], ["html"]
        self.held: list[str] = []
        self.tags = self.regions = 0
        self.plain = False

    def state(self) -> tuple[bool, int | None, int, bool, bool]:
        return self.open[-1][1:] if self.open else (False, None, 0, False, False)

    def end_line(self) -> None:
        text = " ".join("".join(self.held).split())
        if text or self.tags:
            _, region, element, *_ = self.state()
            self.lines.append(Line(text, self.tags, region, element, not self.plain))
        self.held, self.tags, self.plain = [], 0, False

    def pop_to(self, tags: tuple[str, ...], stop: frozenset[str]) -> None:
        """Close the innermost open element of ``tags``, unless one of ``stop`` stands before it."""
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] in tags:
                self.end_line()
                del self.open[at:]
                return
            if self.open[at][0] in stop:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS_P:
            self.pop_to(("p",), BLOCKS - {"p"})
        if tag in CLOSES:
            self.pop_to(CLOSES[tag], frozenset(("ul", "ol", "dl", "table", "select", "menu")))
        if tag in BLOCKS:
            self.end_line()
        elif tag == "br":
            self.held.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        aside, region, parent, link, by_class = self.state()
        if by_class and tag == "main":
            # the one main element of a page stands in no aside: the class is that of a wrapper
            aside = by_class = False
        if not aside:
            aside = tag in ASIDE or (tag == "header" and region is None) or tag not in PAGE and hidden(attrs)
            if not aside and self.marks and tag not in PAGE and marked(attrs):
                aside = by_class = True
        elif tag in ASIDE or hidden(attrs):
            by_class = False
        if tag in REGIONS:
            # an article within an article or main is part of it
            if region is None:
                self.regions += 1
                region = self.regions
        self.parents.append(parent)
        self.names.append(tag)
        self.open.append((tag, aside, region, len(self.names) - 1, link or tag == "a", by_class))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS | REGIONS | ASIDE:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                if tag in BLOCKS:
                    self.end_line()
                del self.open[at:]
                return
        if tag == "p":
            self.end_line()

    def handle_data(self, data: str) -> None:
        aside, _, _, link, _ = self.state()
        if not aside:
            self.held.append(data)
            self.plain = self.plain or not link and not data.isspace()


def marked(attrs: list[tuple[str, str | None]]) -> bool:
    """Whether class, id or role mark something beside the article."""
    for name, value in attrs:
        if name in ("class", "id", "role") and value:
            for words in map(SPLIT.split, value.lower().split()):
                if any(word in MARKS and WITH.isdisjoint(words[:at]) for at, word in enumerate(words)):
                    return True
    return False


def hidden(attrs: list[tuple[str, str | None]]) -> bool:
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and value and "display:none" in value.replace(" ", "").lower():
            return True
    return False


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, reach), kernel / kernel.sum(), "valid")


def lines_of(html: str, marks: bool) -> LineEvents:
    events = LineEvents(marks)
    events.feed(html)
    events.close()
    events.end_line()
    return events


def container(events: LineEvents, elements: list[int]) -> int:
    """The smallest element around lines that stand in ``elements``, for a single line the one around its own; 0 for the page."""
    parents = events.parents
    if len(elements) == 1:
        return parents[elements[0]]
    # an element has a larger number than its parent
    left = [-element for element in set(elements)]
    heapq.heapify(left)
    while len(left) > 1:
        last = heapq.heappop(left)
        if left[0] != last:
            heapq.heappush(left, -parents[-last])
    return -left[0]


def within(events: LineEvents, element: int) -> list[bool]:
    """For each element whether it is ``element`` or stands in it."""
    inside: list[bool] = []
    for number, parent in enumerate(events.parents):
        inside.append(number == element or number > element and inside[parent])
    return inside


def main_text(html: str | None) -> str:
    """The article of one page: its blocks, white space single, joined by two line feeds.

    Where every text stands in elements whose classes mark something beside the article, the classes are ignored.
    Without ``article`` and ``main`` all blocks of the smallest element around the dense lines are returned; if that is the
    page itself, lines of links alone before the first and after the last dense line are taken for menus.
    """
    events = lines_of(html or "", True)
    if not any(line.text for line in events.lines):
        events = lines_of(html or "", False)
    lines = events.lines
    if not any(line.text for line in lines):
        return ""
    own = np.array([len(line.text) / max(1, line.tags) for line in lines], dtype=float)
    ratio = smoothed(own)
    told = np.array([bool(line.text) for line in lines])
    threshold = min(ratio[told].max(), ratio.std())
    content = told & (ratio >= threshold)
    regions = {line.region for line, inside in zip(lines, content) if inside and line.region}
    if not regions and any(line.region and line.text for line in lines):
        regions = {line.region for line in lines if line.region and line.text}
    if regions:
        return "\n\n".join(line.text for line in lines if line.text and line.region in regions)
    # smoothing lifts lines of menus beside the content; they do not say where it is
    dense = content & (own >= threshold)
    dense = np.flatnonzero(dense if dense.any() else content)
    around = container(events, [lines[at].element for at in dense])
    inside = within(events, around)
    whole_page = around == 0 or events.names[around] in PAGE
    for at, line in enumerate(lines):
        if line.text and inside[line.element]:
            content[at] |= not (whole_page and line.linked and not dense[0] < at < dense[-1])
    return "\n\n".join(line.text for line, stays in zip(lines, content) if stays)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``pages`` with ``text`` (an old column of this name gives way), the main text of ``html``.

    Character references are decoded. A NULL or empty page, and one whose text all stands in menus, forms and the like,
    has ''. Broken markup is read as browsers do for paragraphs and lists left open; other elements end with their
    parent. Each page is read on its own and whole, so repeated rows have equal results; empty tables stay empty.
    """

    @F.pandas_udf("string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(html) for html in batch], dtype=object)

    return pages.withColumn("text", read("html"))
