"""Main text of web pages by text density.

The standard library's streaming parser emits events; every block boundary begins a new line. The score of a
line is the logarithm of its text-to-tag ratio (its characters over one plus its tags) times a weight of its region.
Scores are smoothed by a Gaussian along the page and split by a threshold between their two clusters. Regions are
the sectioning and grouping elements and those with a weight of their own, nested ones too; a line belongs to the
innermost. What is content:

* a region with a line in the upper cluster, with all of its own lines, headings and short paragraphs too, and the
  article or main element that it stands in, if no weight but that of the mark is between them;
* a region inside of a content region (other than the body itself) whose weight is not less, outside of article and main
  elements only if at most half of its text is links;
* if one article or main element is content, the others with no less than the usual weight, links being at most half of their text;
* if no region has such a line, the region of the longest line.

Weights say what is likely, density decides: article and main elements count ``MARKED`` times; menus, page headers,
footers, sidebars, dialogs, and blocks whose class names boilerplate count ``UNLIKELY``; forms ``FORM``; blocks of an article
whose class has a word that may name boilerplate ``DOUBTED``. Ids count like classes outside of articles. Headings and
paragraphs inside of an article, and ids of headings and paragraphs anywhere, are not looked at: an anchor may have any
name. Only what is no text of the page takes no part: scripts, styles, templates, form controls, embedded objects, and hidden elements.

Defined results: null, empty and text-free pages give the empty string, as do pages of which every line is unlikely;
markup that is not closed ends with its parent or the page; a page of one short line keeps it; equal scores are one
cluster, the upper one; of longest lines that tie the first decides; repeated rows are extracted
each for itself; a null page_id or url is carried as null; other columns are not read. Pages of any
length are read whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gneiss.llm.common import map_arrow, strings, with_ids

SIGMA = 2.0
#: What a line's score is multiplied by: inside of an article or main element, and where a name or element makes it less likely.
MARKED, DOUBTED, FORM, UNLIKELY = 2.0, 0.75, 0.25, 0.0625

# Names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead title tr ul".split()
)
REGIONS = frozenset("article body div dl figure header main ol section table td ul".split())
NEVER = frozenset(
    "audio button canvas datalist embed head iframe input noscript object optgroup option script select style svg template textarea "
    "title video".split()
)
UNLIKELY_TAGS = frozenset("aside dialog footer menu nav".split())
UNLIKELY_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog menu menubar navigation search status toolbar".split()
)
PLAIN = frozenset("h1 h2 h3 h4 h5 h6 p".split())
# Words of classes and ids that name boilerplate, and words that may.
_UNLIKELY_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|breadcrumbs?|comments?|consent|cookies?|disqus|"
    r"footer|gdpr|masthead|modal|nav|navbar|navigation|newsletter|popup|replies|reply|respond|sidebar|sponsor|sponsored|"
    r"subscribe|toolbar)(?:$|[\s_-])",
    re.IGNORECASE,
)
_DOUBTED_NAMES = re.compile(
    r"(?:^|[\s_-])(?:banner|header|menu|notices?|promo|promoted|related|share|sharing|social|widget)(?:$|[\s_-])", re.IGNORECASE
)
#: What an open paragraph is closed by.
_CLOSES_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul".split()
)


class Region(NamedTuple):
    parent: int  # itself for the page
    spreads: bool  # whether regions inside of it are content if it is
    weight: float
    article: int | None  # the innermost article or main element that it is or is in


class Line(NamedTuple):
    text: str
    tags: int
    linked: int  # characters in links
    region: int
    weight: float

    def score(self) -> float:
        return math.log1p(len(self.text) / (1 + self.tags)) * self.weight


class _Open(NamedTuple):
    tag: str
    never: bool
    region: int
    link: bool


class _Events(HTMLParser):
    """Lines and regions of the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.now = _Open("", False, 0, False)
        self.stack: list[_Open] = []
        self.regions = [Region(0, False, 1.0, None)]
        self.lines: list[Line] = []
        self.text: list[str] = []
        self.tags = self.linked = 0

    def end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            region = self.regions[self.now.region]
            self.lines.append(Line(text, self.tags, self.linked, self.now.region, region.weight * (1.0 if region.article is None else MARKED)))
        if self.text:
            self.text = []
        self.tags = self.linked = 0

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSES_P:
            self._close_p()
        if tag in BLOCKS:
            self.end_line()
        self.tags += 1
        if tag in VOID:
            return
        _, never, region, link = self.now
        if not never:
            never = tag in NEVER or any(name == "hidden" or name == "aria-hidden" and value == "true" for name, value in attrs)
        if not never:
            outer = self.regions[region]
            weight = min(outer.weight, _weight(tag, attrs, outer.article is not None))
            if tag in REGIONS or weight < outer.weight and tag in BLOCKS:
                article = len(self.regions) if tag in ("article", "main") else outer.article
                self.regions.append(Region(region, tag != "body", weight, article))
                region = len(self.regions) - 1
        self.now = _Open(tag, never, region, link or tag == "a")
        self.stack.append(self.now)

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            if tag not in ("p", "div"):
                self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.end_line()
        self.tags += 1
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag == tag:
                self._cut(i)
                return
            if self.stack[i].tag in REGIONS and tag not in REGIONS and tag not in NEVER:
                return  # a stray end tag closes nothing outside of its region

    def _close_p(self) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag == "p":
                self.end_line()
                self._cut(i)
                return
            if self.stack[i].tag in BLOCKS:
                return

    def _cut(self, i: int) -> None:
        del self.stack[i:]
        self.now = self.stack[-1] if self.stack else _Open("", False, 0, False)

    def handle_data(self, data):
        if not self.now.never:
            self.text.append(data)
            if self.now.link:
                self.linked += len(data)


def _weight(tag: str, attrs: list[tuple[str, str | None]], marked: bool) -> float:
    """How likely an element makes its text by its tag, role, class and id; the least that one of them says."""
    if tag in ("html", "body") or marked and tag in PLAIN:
        return 1.0
    weight = UNLIKELY if tag in UNLIKELY_TAGS or tag == "header" and not marked else FORM if tag == "form" else 1.0
    for name, value in attrs:
        if name == "role" and (value or "").lower() in UNLIKELY_ROLES:
            weight = UNLIKELY
        elif value and (name == "class" or name == "id" and not marked and tag not in PLAIN):
            if _UNLIKELY_NAMES.search(value):
                weight = min(weight, DOUBTED if tag in ("article", "main") else UNLIKELY)
            elif _DOUBTED_NAMES.search(value):
                weight = min(weight, DOUBTED if marked or tag in ("article", "main") else UNLIKELY)
    return weight


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing; weights outside of the page are left out of the mean."""
    reach = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    middle = slice(reach, reach + len(ratios))
    return np.convolve(ratios, kernel)[middle] / np.convolve(np.ones(len(ratios)), kernel)[middle]


def threshold(values: np.ndarray) -> float:
    """The middle between the means of the two clusters of values (one-dimensional 2-means)."""
    low, high = float(values.min()), float(values.max())
    for _ in range(20):
        cut = (low + high) / 2
        below, above = values[values < cut], values[values >= cut]
        if not len(below) or not len(above):
            break
        new = float(below.mean()), float(above.mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def dense_regions(lines: list[Line], sigma: float) -> set[int]:
    """The regions with a line in the upper cluster."""
    values = smoothed(np.array([line.score() for line in lines]), sigma)
    cut = threshold(values)
    # A line lifted by its neighbours alone does not make its region content.
    return {line.region for line, value in zip(lines, values, strict=True) if value >= cut and line.score() >= cut / 2}


def content_regions(lines: list[Line], regions: list[Region], sigma: float) -> set[int]:
    content = dense_regions(lines, sigma) or {max(lines, key=lambda line: len(line.text)).region}
    content |= {a for r in content if (a := regions[r].article) is not None and regions[a].weight <= regions[r].weight}
    size, linked = np.zeros(len(regions)), np.zeros(len(regions))
    for line in lines:
        size[line.region] += len(line.text)
        linked[line.region] += line.linked
    marked = any(regions[r].article is not None for r in content)
    for number, (parent, _, weight, article) in enumerate(regions):  # parents come before their children
        prose = 2 * linked[number] <= size[number]
        if parent in content and regions[parent].spreads and weight >= regions[parent].weight and (prose or article is not None):
            content.add(number)
        elif marked and article == number and weight >= 1 and prose and size[number]:
            content.add(number)
    return content


def main_text(html: str | None, sigma: float = SIGMA) -> str:
    if not html:
        return ""
    events = _Events()
    events.feed(html)
    events.close()
    events.end_line()
    if all(events.regions[line.region].weight <= UNLIKELY for line in events.lines):
        return ""
    content = content_regions(events.lines, events.regions, sigma)
    return " ".join(line.text for line in events.lines if line.region in content)


def extract_pages(
    df: DataFrame, sigma: float = SIGMA, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Per page: page_id, url and the main text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, sigma) for h in strings(batch, html_col)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col).cast(pa.int64()), batch.column(url_col), pa.array(texts, pa.string())],
                ["page_id", "url", "text"],
            )

    return map_arrow(with_ids(df, id_col), [id_col, url_col, html_col], run, "page_id long, url string, text string")
