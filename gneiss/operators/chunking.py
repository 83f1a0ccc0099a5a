"""Documents to chunks: sections by heading, tables as chunks of their own, prose in windows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gneiss.config import DEFAULTS, Settings
from gneiss.functions import html_flow, tables
from gneiss.functions.columns import free
from gneiss.functions import text as T
from gneiss.schemas import CHUNK_COLUMNS

EVENTS = "seq int, kind string, tag string, text string, title string, rows array<array<string>>"


def html_events(df: DataFrame, key: str, html_col: str = "html", settings: Settings = DEFAULTS) -> DataFrame:
    """(key, seq, kind, tag, text, title, rows) of every document, parsed once in Arrow batches."""
    schema = StructType([df.schema[key], *StructType.fromDDL(EVENTS).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, htmls = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(keys), 64):  # a few documents' events at a time
                rows = [{key: k} | e for k, h in zip(keys[at : at + 64], htmls[at : at + 64], strict=True) for e in html_flow.events(h or "", settings)]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return df.select(key, html_col).mapInArrow(run, schema)


def dropped_contents(events: DataFrame, key: str) -> DataFrame:
    """(key, n_dropped): how many tables of contents each document lost; documents that lost none have no row."""
    return events.where("kind = 'contents'").groupBy(key).agg(F.count(F.lit(1)).alias("n_dropped"))


def with_sections(events: DataFrame, key: str, heading) -> DataFrame:
    """Events inside a section: its heading, and ``run``, which changes at headings and tables.

    Columns ``section`` and ``run`` that the events may have give way to these.
    """
    order = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    is_head = (F.col("kind") == "block") & heading
    own = free(events, "head")
    rows = events.where("kind <> 'contents'").withColumn(own, F.coalesce(is_head, F.lit(False)))
    rows = rows.withColumn("section", F.last(F.when(F.col(own), F.col("text")), ignorenulls=True).over(order))
    rows = rows.where("section is not null")
    breaks = F.sum((F.col(own) | (F.col("kind") == "table")).cast("int")).over(order)
    return rows.withColumn("run", breaks).where(~F.col(own)).drop(own)


def chosen_sections(events: DataFrame, key: str, settings: Settings = DEFAULTS) -> DataFrame:
    """Events inside a section, with ``section``, ``run`` and ``way``: by Item headings (0), or, in documents where nothing stands
    under such a heading, by headings in capitals (1). Both are followed in one pass over each document."""
    order = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(key)
    is_block, is_table = F.col("kind") == "block", F.col("kind") == "table"
    heads = (T.is_item_heading(F.col("text")), T.is_caps_heading(F.col("text"), F.col("tag"), settings))
    rows = events.where("kind <> 'contents'").withColumns({f"_head{i}": F.coalesce(is_block & h, F.lit(False)) for i, h in enumerate(heads)})
    rows = rows.withColumns({f"_section{i}": F.last(F.when(F.col(f"_head{i}"), F.col("text")), ignorenulls=True).over(order) for i in (0, 1)})
    inside = [F.col(f"_section{i}").isNotNull() & ~F.col(f"_head{i}") for i in (0, 1)]
    breaks = [F.sum((F.col(f"_section{i}").isNotNull() & (F.col(f"_head{i}") | is_table)).cast("int")).over(order) for i in (0, 1)]
    rows = rows.withColumns({f"_any{i}": F.max(inside[i]).over(whole) for i in (0, 1)} | {f"_run{i}": breaks[i] for i in (0, 1)})
    by_item = F.col("_any0")
    rows = rows.where(F.when(by_item, inside[0]).otherwise(inside[1]))
    pick = lambda name: F.when(by_item, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
    return rows.select(key, "seq", "kind", "text", "title", "rows", pick("_section").alias("section"), pick("_run").alias("run"), F.when(by_item, 0).otherwise(1).alias("way"))


def section_blocks(rows: DataFrame, key: str, settings: Settings = DEFAULTS) -> DataFrame:
    """(key, section, chunk_type, table_title, body, block_seq, way) in document order, of rows with section and run: a run of blocks is
    prose, and a table, which begins a run of its own, is rendered."""
    is_table = F.col("kind") == "table"
    runs = rows.groupBy(key, "section", "run", "kind", "way").agg(
        F.min("seq").alias("seq"), F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("parts"), F.first("title").alias("title"), F.first("rows").alias("rows")
    )
    prose = F.array_join(F.transform("parts", lambda p: p["text"]), " ")
    bodies = F.when(is_table, F.array(tables.render(F.col("rows")))).otherwise(T.sentence_windows(prose, settings.max_chunk_chars))
    return runs.select(
        key, "section", F.when(is_table, "table").otherwise("text").alias("chunk_type"), F.when(is_table, F.col("title")).otherwise("").alias("table_title"),
        "seq", "way", F.posexplode(bodies).alias("part", "body"),
    ).select(key, "section", "chunk_type", "table_title", "body", F.struct("seq", "part").alias("block_seq"), "way")


def document_blocks(df: DataFrame, key: str, html_col: str = "html", settings: Settings = DEFAULTS) -> DataFrame:
    """Blocks by Item headings; where a document has none, by headings in capitals; else its whole text. Markup is parsed once."""
    found = section_blocks(chosen_sections(html_events(df, key, html_col, settings), key, settings), key, settings)
    windows = T.sentence_windows(T.strip_html(F.col(html_col)), settings.max_chunk_chars)
    whole = df.select(
        key, F.lit("Document").alias("section"), F.lit("text").alias("chunk_type"), F.lit("").alias("table_title"),
        F.posexplode(windows).alias("part", "body"),
    ).select(key, "section", "chunk_type", "table_title", "body", F.struct(F.lit(0).alias("seq"), "part").alias("block_seq"), F.lit(2).alias("way"))
    best = F.min("way").over(Window.partitionBy(key))
    return found.unionByName(whole).withColumn("best", best).where("way = best").drop("best", "way")


def chunk_filings(filings: DataFrame, key: str = "source_url", html_col: str = "html", slug_index: bool = False, settings: Settings = DEFAULTS) -> DataFrame:
    """Chunks (see schemas.CHUNK) of filings with ticker, form, filing_date, accession_number,
    period_of_report, source_url, document_name and HTML.

    Numbers run by section text within a filing, so two headings of one slug repeat chunk ids;
    ``slug_index`` numbers by slug instead.
    """
    blocks = document_blocks(filings, key, html_col, settings).where(F.length("body") >= settings.min_chunk_chars)
    by = T.slug(F.col("section")) if slug_index else F.col("section")
    number = F.row_number().over(Window.partitionBy(key, by).orderBy("block_seq")) - 1
    rows = blocks.withColumn("chunk_index", number).join(filings.drop(html_col), key)
    titled = T.text_or_empty(F.col("table_title")) != ""
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    chunks = rows.select(
        T.chunk_id(F.col("accession_number"), F.col("section"), F.col("chunk_index")).alias("chunk_id"),
        "chunk_index", "chunk_type", "table_title", "ticker", "form", "filing_date",
        F.coalesce(F.nullif("period_of_report", F.lit("")), "filing_date").alias("period_of_report"),
        "accession_number", "section",
        F.when(titled, strip(F.concat_ws("\n", "table_title", "body"))).otherwise(F.col("body")).alias("text"),
        "source_url", "document_name", "block_seq",
    )
    return chunks.select(*CHUNK_COLUMNS, "block_seq")
