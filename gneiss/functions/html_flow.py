"""Documents as flat events: leaf blocks, data tables, and tables of contents that are left out.

The standard library's parser walks the markup once. What is kept of it is flat: the strings by
their positions, and for blocks, tables, rows and cells the span of positions that each covers, so
whether one holds another is a comparison of numbers and its text a slice. No end tag is implied: an
element that is not closed covers all that follows, and an end tag closes the latest open element of
its name or nothing. From the events on, everything is column expressions.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import chain
from typing import NamedTuple

from gneiss.config import DEFAULTS, Settings
from gneiss.functions.tables import CONTENTS_ROW, CONTENTS_WORDS, FILLER_CELLS, NUMERIC_CELL, PAGE_HEADING

# Elements that are read as blocks, and elements without content.
BLOCK_TAGS = frozenset(("h1", "h2", "h3", "p", "div", "li", "td", "th"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(("script", "style", "template"))
_KEPT = BLOCK_TAGS | {"table", "tr"}
_FIGURE = re.compile(NUMERIC_CELL.removeprefix("(?U)"))
_LISTED = re.compile(CONTENTS_ROW)
_BLANKS = str.maketrans({"​": " ", "\xa0": " "})


class Span(NamedTuple):
    begin: int
    end: int
    tag: str


class _Reader(HTMLParser):
    """Strings with their positions and spans of elements, in order of their begins."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.at = 0
        self.places: list[int] = []
        self.strings: list[str] = []
        self.shown: list[bool] = []
        self.spans: list[list] = []
        self.open: list[tuple[str, list | None]] = []
        self.names: Counter[str] = Counter()
        self.joins = False  # whether the next text goes on with the last string

    def _step(self) -> int:
        self.at += 1
        self.joins = False
        return self.at

    def handle_starttag(self, tag, attrs):
        begin = self._step()
        if tag in VOID:
            return
        span = [begin, None, tag] if tag in _KEPT else None
        if span:
            self.spans.append(span)
        self.open.append((tag, span))
        self.names[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._step()
        closed = None if self.names[tag] else tag
        while closed != tag:
            closed, span = self.open.pop()
            self.names[closed] -= 1
            if span:
                span[1] = self.at

    def _add(self, value: str, shown: bool) -> None:
        self.places.append(self._step())
        self.strings.append(value)
        self.shown.append(shown)

    def handle_data(self, data):
        if self.joins:
            self.strings[-1] += data
        else:
            self._add(data, not self.open or self.open[-1][0] not in HIDDEN)
            self.joins = True

    def handle_comment(self, data):
        self._add(data, False)

    def handle_decl(self, decl):
        self._add(decl, False)

    def whole(self) -> list[Span]:
        return [Span(begin, self.at + 1 if end is None else end, tag) for begin, end, tag in self.spans]


def clean(value: str) -> str:
    return " ".join(value.translate(_BLANKS).split())


def kind_of(grid: list[list[str]], settings: Settings = DEFAULTS) -> str:
    """What a table is by its rows of cell texts: contents, data, or other."""
    heads = [row[0].lower() for row in grid]
    listed = sum(_LISTED.match(head) is not None for head in heads)
    if CONTENTS_WORDS in " ".join(chain(*grid)).lower() or PAGE_HEADING in heads or listed >= max(3, len(grid) // 2):
        return "contents"
    figures = sum(_FIGURE.match(cell) is not None for cell in chain(*grid))
    large = len(grid) >= settings.min_table_rows and max(map(len, grid)) >= settings.min_table_width
    return "data" if large and figures >= settings.min_numeric_cells else "other"


class _Document:
    """What the reader kept, less the tables of contents found so far."""

    def __init__(self, html: str):
        reader = _Reader()
        reader.feed(html)
        reader.close()
        self.places, self.strings, self.shown = reader.places, reader.strings, reader.shown
        self.spans = reader.whole()
        self.begins = [span.begin for span in self.spans]
        self.gone: list[Span] = []  # apart from each other, in order

    def is_gone(self, at: int) -> bool:
        k = bisect_left(self.gone, (at,)) - 1
        return k >= 0 and at < self.gone[k].end

    def inside(self, outer: Span, tags: tuple[str, ...]) -> Iterator[Span]:
        for k in range(bisect_left(self.begins, outer.begin + 1), bisect_left(self.begins, outer.end)):
            if self.spans[k].tag in tags and not self.is_gone(self.begins[k]):
                yield self.spans[k]

    def text(self, span: Span) -> str:
        run = range(bisect_left(self.places, span.begin), bisect_left(self.places, span.end))
        parts = (self.strings[k].strip() for k in run if self.shown[k] and not self.is_gone(self.places[k]))
        return clean(" ".join(part for part in parts if part))

    def grid(self, table: Span) -> list[list[str]]:
        """Rows of cell texts, fillers and empty cells and rows left out; inner tables' rows count too."""
        rows = ([self.text(cell) for cell in self.inside(row, ("td", "th"))] for row in self.inside(table, ("tr",)))
        kept = ([cell for cell in row if cell and cell not in FILLER_CELLS] for row in rows)
        return [row for row in kept if row]

    def loose(self, walls: list[Span]) -> tuple[list[int], list[str]]:
        """Places and cleaned values of all strings that say something and stand outside of ``walls``."""
        places, texts = [], []
        for place, string in zip(self.places, self.strings, strict=True):
            wall = bisect_left(walls, (place,)) - 1
            if (wall < 0 or place >= walls[wall].end) and (text := clean(string)) and text not in FILLER_CELLS:
                places.append(place)
                texts.append(text)
        return places, texts


def caption(places: list[int], texts: list[str], begin: int, settings: Settings) -> str:
    """Loose text before a place, nearest first until the budget is used up."""
    first = last = bisect_left(places, begin)
    room = settings.title_budget
    while first and room >= 0:
        first -= 1
        room -= len(texts[first])
    return " ".join(texts[first:last])[-settings.title_chars :].strip()


def outermost(spans: list[Span]) -> list[Span]:
    """The spans that stand in no other, in order."""
    out: list[Span] = []
    for span in sorted(spans):
        if not out or span.begin >= out[-1].end:
            out.append(span)
    return out


def events(html: str, settings: Settings = DEFAULTS) -> list[dict]:
    """Leaf blocks, data tables and (without text) tables of contents, in document order.

    Tables of contents are gone before anything else is read; a data table stands for a paragraph of its own.
    """
    document = _Document(html)
    tables = [span for span in document.spans if span.tag == "table"]
    for table in tables:
        if not document.is_gone(table.begin) and kind_of(document.grid(table), settings) == "contents":
            document.gone.append(table)
    grids = {t: rows for t in tables if not document.is_gone(t.begin) and kind_of(rows := document.grid(t), settings) == "data"}
    items = [s for s in document.spans if s in grids or s.tag in BLOCK_TAGS and not document.is_gone(s.begin)]
    out = [(t.begin, "contents", "table", None, None, None) for t in document.gone]
    places, texts = document.loose(outermost([*grids, *document.gone])) if grids else ([], [])
    told = 0
    for item, after in zip(items, [*items[1:], None], strict=False):
        if item.begin < told:
            continue  # in a table that has been told
        if item in grids:
            told = item.end
            out.append((item.begin, "table", "table", None, caption(places, texts, item.begin, settings), grids[item]))
        elif (after is None or after.begin >= item.end) and (text := document.text(item)):
            out.append((item.begin, "block", item.tag, text, None, None))
    names = ("kind", "tag", "text", "title", "rows")
    return [{"seq": seq} | dict(zip(names, found[1:], strict=True)) for seq, found in enumerate(sorted(out, key=lambda x: x[0]))]
