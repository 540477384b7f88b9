"""Main-text extraction: a streaming parser's events, text-to-tag ratios, Gaussian smoothing, threshold clustering.

Each block of a page is a line. Its ratio is its characters over its tags, where a line that is links for the most part
counts what stands outside of them. The logarithms of the ratios are smoothed along the page, so that one very long block
sets no bar for the others, and lines at or above their standard deviation are content. Content lines cluster to regions
between masked lines and runs of links; a region takes along their sibling blocks, the rest of the innermost element that
holds all of its content, and the headings just before it. No element is content by its name: article, main, div and section are judged alike, by their ratios.

Elements and class words only mask. Scripts, forms, footers, sidebars, adverts, notices and reader comments are masked
whatever their ratio. Menus, nav elements among them, have no mask: their text is links, or weakly marked (nav; the words
menu, share, related and the like), which takes a line out only if its own ratio is far below that of the content. A class
word on an element that holds the page's first heading masks nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from porelake.llm.common import small_batches

#: Standard deviation of the smoothing, in lines.
SIGMA = 1.0

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTENT = frozenset(("article", "main"))
#: A line that is links for the most part, or has a weak mark, needs this part of the content's upper quartile of ratios.
LINK_SHARE = 4
#: Neighbouring lines of links that part regions; fewer are links within an article.
LINK_RUN = 3
TOPS = frozenset(("", "html", "body"))
#: Elements whose text is no part of an article; header only outside of one.
BOILERPLATE = frozenset("head title footer aside form script style noscript template iframe object svg canvas button select textarea dialog".split())
MENUS = frozenset(("nav", "menu"))
ROLES = frozenset("banner contentinfo complementary search dialog alert alertdialog form".split())
MENU_ROLES = frozenset(("navigation", "menu", "menubar"))
#: Words of a class or id that mark such parts, and those that are used for parts of articles, too.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|banner|sidebar|side-bar|breadcrumb|breadcrumbs|footer|cookie|cookies|consent|notice|notices|popup|modal|newsletter|subscribe|comment|comments|disqus|replies|login|signup|pagination|pager)(?:$|[\s_-])",
    re.I,
)
WEAK_MARKS = re.compile(r"(?:^|[\s_-])(?:menu|nav|navbar|navigation|overlay|social|share|sharing|related|recommended|respond|widget|toolbar|skip)(?:$|[\s_-])", re.I)
HEADER_MARK = re.compile(r"(?:^|[\s_-])(?:header|masthead|topbar)(?:$|[\s_-])", re.I)
#: A start of one of these closes an open one of the named, up to the given outer elements.
CLOSES = {
    "p": (("p",), ("article", "aside", "blockquote", "body", "div", "footer", "header", "li", "main", "nav", "section", "td", "th")),
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
_ENDS_P = BLOCKS - {"br", "body", "html", "head", "title", "option", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "summary", "figcaption"}


class Line:
    """A block's text and tags, and what its open elements say of it.

    masked by an element's name or role; marked and weak are the open elements with such class words;
    parent is the element that holds the block, path the open elements that a region of it can stand for.
    """

    __slots__ = ("chars", "heading", "linked", "marked", "masked", "parent", "path", "tags", "text", "weak")

    def __init__(self) -> None:
        self.text: list[str] = []
        self.tags, self.chars, self.linked, self.parent, self.path = 0, 0, 0, 0, ()
        self.masked, self.marked, self.weak, self.heading = False, (), (), False


class Element:
    """An open element; masked, marked, weak and content as it hands them on to what it holds."""

    __slots__ = ("content", "marked", "masked", "number", "tag", "weak")

    def __init__(self, tag: str, number: int, masked: bool, marked: tuple[int, ...], weak: tuple[int, ...], content: bool) -> None:
        self.tag, self.number, self.masked, self.marked, self.weak, self.content = tag, number, masked, marked, weak, content


class Reader(HTMLParser):
    """Turns a page's events into lines."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.outside = Element("", 0, False, (), (), False)
        self.stack: list[Element] = []
        self.elements, self.in_link = 0, False
        self.headed: frozenset[int] | None = None  # the elements around the first h1
        self.lines: list[Line] = []
        self.open_line(False)

    def here(self) -> Element:
        return self.stack[-1] if self.stack else self.outside

    def open_line(self, heading: bool, own: bool = False) -> None:
        """A new line, or the last one anew if it has no text; own: the innermost element is the line's block."""
        if not self.lines or self.lines[-1].text:
            self.lines.append(Line())
        line, at = self.lines[-1], self.here()
        line.masked, line.marked, line.weak, line.heading = at.masked, at.marked, at.weak, heading
        blocks = [x for x in self.stack if x.tag in BLOCKS]
        held = blocks[:-1] if own else blocks
        line.parent = held[-1].number if held else 0
        line.path = tuple(x.number for x in blocks if x.tag not in TOPS)

    def close_open(self, tags: tuple[str, ...], outer: tuple[str, ...]) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag in tags:
                del self.stack[i:]
                return
            if self.stack[i].tag in outer:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.lines[-1].tags += 1
        if tag in CLOSES:
            self.close_open(*CLOSES[tag])
        elif tag in _ENDS_P:
            self.close_open(*CLOSES["p"])
        self.in_link |= tag == "a"
        if tag in VOID:
            if tag in BLOCKS:
                self.open_line(False)
            return
        self.elements += 1
        at, named = self.here(), dict(attrs)
        mark = f"{named.get('class') or ''} {named.get('id') or ''}"
        opened = Element(tag, self.elements, at.masked, at.marked, at.weak, at.content or tag in CONTENT)
        role = (named.get("role") or "").lower()
        if tag == "h1" and self.headed is None and not at.masked:
            self.headed = frozenset(x.number for x in self.stack)
        if tag in BOILERPLATE or role in ROLES or "hidden" in named or (tag == "header" and not at.content):
            opened.masked = True
        elif tag in CONTENT:
            opened.marked = opened.weak = ()  # a class word on an element left open ends here
        elif mark != " " and tag not in TOPS:
            if MARKS.search(mark) or (not at.content and HEADER_MARK.search(mark)):
                opened.marked += (self.elements,)
            if WEAK_MARKS.search(mark):
                opened.weak += (self.elements,)
        if tag in MENUS or role in MENU_ROLES:
            opened.weak += (self.elements,)
        self.stack.append(opened)
        if tag in BLOCKS:
            self.open_line(tag in HEADINGS, True)
        elif (opened.masked, opened.marked, opened.weak) != (at.masked, at.marked, at.weak):
            self.open_line(False)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.lines[-1].tags += 1
        self.in_link &= tag != "a"
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag == tag:
                before = self.here()
                del self.stack[i:]
                at = self.here()
                if tag in BLOCKS or (before.masked, before.marked, before.weak) != (at.masked, at.marked, at.weak):
                    self.open_line(False)
                return

    def handle_data(self, data: str) -> None:
        line = self.lines[-1]
        line.text.append(data)
        line.chars += len(data)
        line.linked += len(data) * self.in_link

    def unknown_decl(self, data: str) -> None:
        """Marked sections are no text."""


def read_lines(html: str) -> list[Line]:
    """The page's lines in order; marks on elements around its first h1 are taken away."""
    reader = Reader()
    try:
        reader.feed(html)
        reader.close()
    except AssertionError:  # a declaration that the parser gives up on: read as text
        reader = Reader()
        reader.feed(html.replace("<!", "&lt;!"))
        reader.close()
    if reader.headed:
        for line in reader.lines:
            line.marked = tuple(e for e in line.marked if e not in reader.headed)
            line.weak = tuple(e for e in line.weak if e not in reader.headed)
    return reader.lines


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing along the page; weights beyond its ends are left out and the rest made to sum to one."""
    reach = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(ratios, kernel, "full")[reach : reach + len(ratios)] / np.convolve(np.ones(len(ratios)), kernel, "full")[reach : reach + len(ratios)]


def _runs(links: np.ndarray) -> np.ndarray:
    """Lines that lie in a run of LINK_RUN or more lines of links."""
    out, at = np.zeros(len(links), bool), 0
    for i in range(len(links) + 1):
        if i == len(links) or not links[i]:
            out[at:i] = i - at >= LINK_RUN
            at = i + 1
    return out


def text_to_tag(chars: int, tags: int) -> float:
    return chars / tags


def main_text(html: str | None, sigma: float = SIGMA, ratio: Callable[[int, int], float] = text_to_tag) -> str:
    """The page's content as one line of text; empty for null, empty and contentless pages. All of a page is read."""
    if not html:
        return ""
    found = [(line, text) for line in read_lines(html) if (text := " ".join("".join(line.text).split()))]
    if not found:
        return ""
    lines, texts = [x for x, _ in found], [t for _, t in found]
    masked = np.array([x.masked or bool(x.marked) for x in lines], bool)
    weak = np.array([bool(x.weak) for x in lines], bool)
    linked = np.array([2 * x.linked > x.chars for x in lines], bool)
    outside = [max(0, len(t) - x.linked) if 2 * x.linked > x.chars else len(t) for x, t in found]
    own = np.array([ratio(n, max(1, x.tags)) for x, n in zip(lines, outside)], float)
    own[masked] = 0.0
    smooth = smoothed(np.log1p(own), sigma)
    content = (smooth >= smooth.std()) & (own > 0)
    plain = own[content & ~linked & ~weak]
    least = np.percentile(plain, 75) / LINK_SHARE if len(plain) else np.inf
    content &= ~((linked | weak) & (own < least))
    menus = _runs((linked | weak) & ~masked & ~content)
    closed = masked | menus
    part = np.cumsum(closed)
    held = {(at, x.parent) for x, yes, at in zip(lines, content, part) if yes and not x.weak}
    around: dict[int, tuple[int, ...]] = {}  # by part, the elements that hold all of its content
    for x, yes, at in zip(lines, content, part.tolist()):
        if yes and not x.weak:
            around[at] = tuple(e for e in around.get(at, x.path) if e in x.path)
    held |= {(at, path[-1]) for at, path in around.items() if path}
    keep = content.copy()
    for i, x in enumerate(lines):
        keep[i] |= not closed[i] and not weak[i] and any((part[i], e) in held for e in (x.parent, *x.path))
    for i in range(len(found) - 2, -1, -1):
        keep[i] |= lines[i].heading and not masked[i] and not weak[i] and keep[i + 1]
    return " ".join(text for text, yes in zip(texts, keep) if yes)


def extract(pages: DataFrame, sigma: float = SIGMA) -> DataFrame:
    """(page_id, url, text, n_chars): one row for each row of pages, in no order; other columns are not read.

    Null and empty html and pages without content give the empty text and 0; null ids and urls stay null. Repeated rows
    come back as often, each read for itself; ties of ratios are no matter, as lines are kept by value. Very long pages are
    read whole, whatever their length. An empty table gives no rows.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), sigma) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    small_batches(pages.sparkSession)
    return pages.selectExpr("cast(page_id as long) as page_id", "cast(url as string) as url", "cast(html as string) as html").mapInArrow(rows, "page_id long, url string, text string, n_chars long")
