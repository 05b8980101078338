"""Operator 1: main text of web pages.

The standard library's parser streams events; text between block tags forms a line. A line's ratio is its characters by its tags; in
menus, footers, sidebars and forms it is 0, and class words of adverts, notices, comments and the like (MARKS) lower it. The ratios
are smoothed with a Gaussian kernel and cut at a threshold: neighbouring lines above it form content regions, parted where an article
begins or ends. A page without a region has no text.

The regions choose the elements that are returned: the outermost article, or else the innermost main element, around a region; without
these, the innermost element around it, if it is no fragment beside a larger one. Chosen elements are returned whole, so that
short paragraphs in them stay, but for lines in menus, footers, sidebars, forms and marked elements that are no content themselves.

Marks are a hint, no verdict: they don't count for an element that holds a main element, a heading of the first level or an article,
nor for elements around the largest region on pages without article and main, or where all content is marked. Of marks of reader comments only the first holds. A
header loses all but its headings inside an article, and all elsewhere.

Null and empty html give an empty text. A tag cut off by the end of the page is dropped; a cut-off character reference stays as it is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import small_batches

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose text is never shown as text, and elements that are no part of an article.
SILENT = set("applet audio button canvas embed head iframe input label legend math noframes noscript object option script select style svg template textarea title video".split())
DROPPED = set("aside dialog fieldset footer form menu nav".split())
CONTAINERS = set("article body div main section table td".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Words in class, id or role that make an element less likely a part of the article; COMMENTS are those of readers.
COMMENTS = set("comment comments commentlist disqus replies reply respond".split())
MARKS = COMMENTS | set("ad ads adbox advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs consent contentinfo cookie cookies footer form header login masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted promotion related search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split())
UNMARKED = {"html", "body", "main"}
#: What a mark leaves of a line's ratio, and the share of the largest region's weight that an element without article or main must hold.
MARKED, FRAGMENT = 0.001, 0.25
#: The share of the threshold that a line's own ratio must exceed for its neighbours to lift it.
LIFTED = 0.1
CLOSED_BY_SAME = set("li dd dt td th tr option".split())
SPACE = re.compile(r"\s+")
CUT_TAG = re.compile(r"<(?:[A-Za-z/!?][^>]*)?\Z")
#: Characters fed at once; the parser keeps its state between feeds.
FEED = 1 << 16


class Line(NamedTuple):
    text: str
    tags: int
    container: int
    marks: tuple[int, ...]
    dropped: bool
    heading: bool


def mark_of(tag: str, attrs: list[tuple[str, str | None]]) -> str | None:
    """"hidden", "comment", "other" or None. An article is marked only by a whole name, as its class often names what else the page has."""
    found = None
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and re.search(r"display\s*:\s*none", value, re.I):
            return "hidden"
        if name in ("class", "id", "role") and value and tag not in UNMARKED:
            words = set(value.lower().split() if tag == "article" else re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()))
            found = "comment" if words & COMMENTS else "other" if words & MARKS else found
    return found


class Lines(HTMLParser):
    """Collects the lines of a page, each with the element that holds it and the marked elements around it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, int, int, int]] = []  # tag, silent, dropped, header, marked
        self.opened: Counter[str] = Counter()
        self.silent = self.dropped = self.headers = 0
        self.names, self.parents = [""], [0]  # containers
        self.container = 0
        self.marks: tuple[int, ...] = ()
        self.kinds: list[str] = []  # of marked elements
        self.void: set[int] = set()
        self.lines: list[Line] = []
        self.parts: list[tuple[str, tuple[int, ...]]] = []
        self.tags = 0
        self.heading = False

    def flush(self) -> None:
        shown = [m for text, m in self.parts if text.strip()]
        if shown:
            marks = min(shown, key=len)  # marked elements inside a line go, unless the whole line is in them
            text = SPACE.sub(" ", "".join(t for t, m in self.parts if len(m) <= len(marks))).strip()
            in_header = self.headers and not (self.heading and self.opened["article"])
            self.lines.append(Line(text, max(1, self.tags), self.container, marks, bool(self.dropped or in_header), self.heading))
        self.parts, self.tags = [], 0

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag, silent, dropped, header, marked = self.stack.pop()
            self.opened[tag] -= 1
            self.silent -= silent
            self.dropped -= dropped
            self.headers -= header
            if marked:
                self.marks = self.marks[:-1]
            if tag in CONTAINERS:
                self.container = self.parents[self.container]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.flush()
            for depth in range(len(self.stack) - 1, -1, -1):  # an open paragraph ends where a block begins
                name = self.stack[depth][0]
                if name == "p" or name == tag and tag in CLOSED_BY_SAME:
                    self.pop_to(depth)
                    break
                if name in BLOCKS:
                    break
            self.heading = tag in HEADINGS
        self.tags += 1
        if tag == "br":
            self.parts.append((" ", self.marks))
        if tag in VOID:
            return
        mark = mark_of(tag, attrs)
        if tag in ("main", "h1") or tag == "article" and not mark:
            self.void.update(m for m in self.marks if tag != "article" or self.kinds[m] != "comment")
        if mark in ("comment", "other"):
            self.marks += (len(self.kinds),)
            self.kinds.append(mark)
        if tag in CONTAINERS:
            self.names.append(tag)
            self.parents.append(self.container)
            self.container = len(self.names) - 1
        self.stack.append((tag, int(tag in SILENT or mark == "hidden"), int(tag in DROPPED), int(tag == "header"), int(mark in ("comment", "other"))))
        self.opened[tag] += 1
        self.silent += self.stack[-1][1]
        self.dropped += self.stack[-1][2]
        self.headers += self.stack[-1][3]

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
            self.heading = False
        self.tags += 1
        if self.opened[tag]:
            for depth in range(len(self.stack) - 1, -1, -1):
                if self.stack[depth][0] == tag:
                    self.pop_to(depth)
                    break

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append((data, self.marks))

    def around(self, container: int) -> Iterator[int]:
        """A container and those around it, innermost first."""
        while container:
            yield container
            container = self.parents[container]

    def held_by(self) -> list[int]:
        """For each container the outermost article, or else the innermost main element, that it is or lies in; 0 without."""
        article, main = [0], [0]
        for c, name in enumerate(self.names[1:], 1):
            article.append(article[self.parents[c]] or (c if name == "article" else 0))
            main.append(c if name == "main" else main[self.parents[c]])
        return [a or m for a, m in zip(article, main, strict=True)]


def content_lines(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """True for the lines whose smoothed ratio of text to tags reaches the threshold: the standard deviation of the smoothed ratios, or their mean where that is lower. A line whose own ratio is far below it can't be lifted by its neighbours, nor one of ratio 0."""
    radius = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    padded = np.pad(ratios, radius, mode="reflect" if len(ratios) > radius else "edge")
    smooth = np.convolve(padded, kernel / kernel.sum(), mode="valid")
    threshold = min(smooth.std(), smooth.mean())
    return (smooth >= threshold) & (ratios > LIFTED * threshold)


def regions_of(content: np.ndarray, held: np.ndarray) -> list[np.ndarray]:
    """Runs of neighbouring content lines, parted where an article or main element begins or ends."""
    at = np.flatnonzero(content)
    cuts = np.flatnonzero((np.diff(at) > 1) | (np.diff(held[at]) != 0)) + 1
    return [r for r in np.split(at, cuts) if len(r)]


def main_text(html: str | None, sigma: float = 1.0) -> str:
    if not html:
        return ""
    html = CUT_TAG.sub("", html) if html.rfind("<") > html.rfind(">") else html
    page = Lines()
    for at in range(0, len(html), FEED):
        page.feed(html[at : at + FEED])
    page.close()
    page.flush()
    lines = page.lines
    if not lines:
        return ""
    sizes = np.array([len(line.text) for line in lines], float)
    plain = np.where([line.dropped for line in lines], 0.0, sizes / [line.tags for line in lines])
    holder = page.held_by()
    held = np.array([holder[line.container] for line in lines])
    readers = np.array([any(page.kinds[m] == "comment" for m in line.marks) for line in lines])

    def unmark(content: np.ndarray) -> None:
        """The largest region takes the marks off the elements around it."""
        best = max(regions_of(content, held), key=lambda r: sizes[r].sum(), default=())
        if len(best):
            page.void.update(set(lines[best[0]].marks).intersection(*(lines[i].marks for i in best)))

    def judged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        marked = np.array([not page.void.issuperset(line.marks) for line in lines])
        ratios = np.where(marked, MARKED, 1.0) * plain
        return marked, ratios, content_lines(ratios, sigma)

    if not held.any():
        unmark(content_lines(np.where(readers, 0.0, plain), sigma))
    marked, ratios, content = judged()
    if content.any() and marked[content].all():
        unmark(content)
        marked, ratios, content = judged()
    regions = regions_of(content, held)
    if not regions:
        return ""
    weight = [sizes[r].sum() for r in regions]
    dense = content & (ratios >= ratios.mean())  # a region may blur over an article's edge: text beside one must be dense by itself
    articles = any(page.names[h] == "article" for h in held[content])
    best_article = max((w for r, w in zip(regions, weight, strict=True) if held[r[0]]), default=0.0)
    chosen: set[int] = set()
    kept = np.zeros(len(lines), bool)
    alone: list[np.ndarray] = []
    for region, w in zip(regions, weight, strict=True):
        own = int(held[region[0]])
        if own:
            if page.names[own] == "article" or not articles or dense[region].any():
                kept |= held == own
        elif not best_article or w >= FRAGMENT * best_article and dense[region].any():
            common: set[int] | None = None
            for c in {lines[i].container for i in region}:
                common = set(page.around(c)) if common is None else common & set(page.around(c))
            common = {c for c in common or () if page.names[c] != "body" and not (best_article and holder[c])}
            if common and not best_article:
                chosen.add(max(common))  # the innermost element around the whole region
            elif best_article:
                kept[region] = True
            else:
                alone.append(region)
    if chosen:
        inside = {0: False}
        for c in range(1, len(page.names)):  # a container comes after the one around it
            inside[c] = c in chosen or inside[page.parents[c]]
        kept |= np.array([inside[line.container] for line in lines])
    if alone:  # regions that no element holds: all from the first region to the last
        first, last = int(regions[0][0]), int(regions[-1][-1])
        while first and lines[first - 1].heading:
            first -= 1
        kept[first : last + 1] = True
    no_part = marked | np.array([line.dropped for line in lines])
    return "\n".join(lines[i].text for i in np.flatnonzero(kept & (content | ~no_part)))


def extract_main_text(pages: DataFrame, sigma: float = 1.0) -> DataFrame:
    """pages(page_id, url, html, ...) -> page_id, url, text, n_chars: one row for each page, no shuffle.

    Null or empty html: empty text and 0. Repeated rows give repeated rows; other columns are ignored.
    """
    small_batches(pages.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, sigma) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    source = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(rows, f"page_id {source.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint")
