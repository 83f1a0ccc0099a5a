"""Predicates and rendering of table grids (arrays of rows of cell texts)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gneiss.config import DEFAULTS, Settings

# A cell that is a figure, cells that only align, and what tells a table of contents.
NUMERIC_CELL = r"(?U)^\(?\$?\s*-?\d[\d,]*(\.\d+)?\s*\)?%?$"
FILLER_CELLS = ("$", "(", ")", "%", "*", "—", "-", "|")
CONTENTS_WORDS, PAGE_HEADING, CONTENTS_ROW = "table of contents", "page", r"(?i)^(item|part)\b"


def without_fillers(rows: Column) -> Column:
    fillers = F.array(*map(F.lit, FILLER_CELLS))
    kept = F.transform(rows, lambda r: F.filter(r, lambda c: (c != "") & ~F.array_contains(fillers, c)))
    return F.filter(kept, lambda r: F.size(r) > 0)


def numeric_cells(rows: Column) -> Column:
    return F.size(F.filter(F.flatten(rows), lambda c: c.rlike(NUMERIC_CELL)))


def is_contents(rows: Column) -> Column:
    """A table of contents: says so, has a 'page' column, or is mostly Item and Part rows."""
    said = F.lower(F.array_join(F.flatten(rows), " ")).contains(CONTENTS_WORDS)
    page = F.exists(rows, lambda r: F.lower(F.element_at(r, 1)) == PAGE_HEADING)
    items = F.size(F.filter(rows, lambda r: F.element_at(r, 1).rlike(CONTENTS_ROW)))
    return said | page | (items >= F.greatest(F.lit(3), F.floor(F.size(rows) / 2)))


def is_data(rows: Column, settings: Settings = DEFAULTS) -> Column:
    width = F.array_max(F.transform(rows, F.size))
    return (
        (F.size(rows) >= settings.min_table_rows)
        & (numeric_cells(rows) >= settings.min_numeric_cells)
        & (width >= settings.min_table_width)
        & ~is_contents(rows)
    )


def render(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ")), "\n")
