"""Filing lists: the registry's JSON as tables, saved metadata, raw documents, and a polite client."""

from __future__ import annotations

import json
import re
import time
import urllib.request
from collections.abc import Callable
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.functions import text as T
from gneiss.functions.columns import free
from gneiss.operators.chunking import chunk_filings
from gneiss.schemas import SAVED_FILING, SUBMISSIONS, TICKER_MAP

# Where the registry publishes.
TICKERS_URL = "https://www.sec.gov/files/company_tickers.json"
SUBMISSIONS_URL = "https://data.sec.gov/submissions/CIK{cik}.json"
DOCUMENT_URL = "https://www.sec.gov/Archives/edgar/data/{cik}/{accession}/{document}"
DEFAULT_FORMS = ("10-K", "10-Q", "8-K", "DEF 14A")


def tickers(raw: DataFrame, json_col: str = "value") -> DataFrame:
    """(ticker, cik, name) of the registry's ticker map; cik has ten digits."""
    entries = raw.select(F.explode(F.map_values(F.from_json(json_col, TICKER_MAP))).alias("e"))
    digits = F.col("e.cik_str").cast("string")
    cik = F.when(F.length(digits) < 10, F.lpad(digits, 10, "0")).otherwise(digits)
    ticker = F.upper("e.ticker")
    return entries.select(ticker.alias("ticker"), cik.alias("cik"), F.coalesce(F.nullif("e.title", F.lit("")), ticker).alias("name"))


def resolve(known: DataFrame, ticker: str) -> tuple[str, str, str]:
    """(ticker, cik, name); ValueError if the ticker is no ticker or unknown."""
    wanted = (ticker or "").strip().upper()
    if not re.match(T.TICKER, wanted):
        raise ValueError(f"{ticker!r} is not a ticker")
    row = known.where(F.col("ticker") == wanted).first()
    if row is None:
        raise ValueError(f"no company is known as {wanted}")
    return tuple(row)


def first_of_each(rows: DataFrame, group: list[str | Column], order: list[str | Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of each group."""
    own = free(rows, "n")
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn(own, n).where(F.col(own) <= limit).drop(own)


def recent_filings(submissions: DataFrame, forms=DEFAULT_FORMS, limit_per_form: int = 5, json_col: str = "value") -> DataFrame:
    """Filings (ticker, cik and JSON in ``submissions``) in the registry's order, the first few of each form.

    A missing, short or empty report date gives way to the filing date.
    """
    recent = submissions.select("ticker", "cik", F.from_json(json_col, SUBMISSIONS)["filings"]["recent"].alias("r"))
    names = ("form", "accessionNumber", "primaryDocument", "filingDate")
    dates = F.coalesce(F.col("r.reportDate"), F.array().cast("array<string>"))
    zipped = F.arrays_zip(*(F.col(f"r.{n}").alias(n) for n in names), dates.alias("reportDate"))
    rows = recent.select("ticker", "cik", F.posexplode(zipped).alias("pos", "f")).where(F.col("f.form").isin(*forms))
    rows = first_of_each(rows, ["ticker", F.col("f.form")], ["pos"], limit_per_form)
    path = F.concat_ws("/", F.regexp_replace("cik", "^0+", ""), F.replace("f.accessionNumber", F.lit("-"), F.lit("")), "f.primaryDocument")
    return rows.select(
        "ticker", "cik", F.col("f.form").alias("form"), F.col("f.filingDate").alias("filing_date"),
        F.col("f.accessionNumber").alias("accession_number"), F.col("f.primaryDocument").alias("primary_document"),
        F.concat(F.lit(DOCUMENT_URL.split("{")[0]), path).alias("source_url"),
        period(F.col("f.reportDate"), F.col("f.filingDate")).alias("period_of_report"),
        F.row_number().over(Window.partitionBy("ticker").orderBy("pos")).alias("filing_seq"),
    )


def period(report_date: Column, filing_date: Column) -> Column:
    return F.coalesce(F.nullif(report_date, F.lit("")), filing_date)


def read_saved(spark: SparkSession, pattern: str) -> DataFrame:
    """Saved metadata (one JSON array a company); missing keys are empty."""
    rows = spark.read.schema(SAVED_FILING).json(pattern, multiLine=True).withColumn("_path", F.input_file_name())
    return rows.select(*(T.text_or_empty(F.col(c)).alias(c) for c in rows.columns if c != "_path"), "_path")


def with_documents(spark: SparkSession, saved: DataFrame, pattern: str) -> DataFrame:
    """Saved filings with the HTML of their files; filings whose file is missing are left out."""
    files = spark.read.format("binaryFile").load(pattern)
    name = F.element_at(F.split("path", "/"), -1)
    files = files.select(name.alias("_file"), F.make_valid_utf8(F.col("content").cast("string")).alias("html"))
    own = F.element_at(F.split("local_path", r"[/\\]"), -1)
    rows = saved.withColumn("_file", own).join(files, "_file")
    return rows.withColumn("document_name", F.col("_file")).drop("_file", "_path")


def load_corpus(spark: SparkSession, data_dir: str, ticker: str | None = None) -> DataFrame:
    """Chunks of the filings saved under ``data_dir`` (raw/ and <TICKER>_filings.json)."""
    saved = read_saved(spark, f"{data_dir}/{ticker.upper() if ticker else '*'}_filings.json")
    return chunk_filings(with_documents(spark, saved, f"{data_dir}/raw/*"))


@dataclass
class Filing:
    ticker: str
    cik: str
    form: str
    filing_date: str
    accession_number: str
    primary_document: str
    source_url: str
    period_of_report: str = ""


class Client:
    """Reads the registry from the driver, one request after the other with a pause between."""

    def __init__(self, user_agent: str, delay: float = 0.15, timeout: float = 30.0, fetch: Callable[[str], bytes] | None = None):
        if not user_agent or "@" not in user_agent or "example.com" in user_agent:
            raise ValueError("the registry wants a user agent with a real contact address")
        self.user_agent, self.delay, self.timeout = user_agent, delay, timeout
        self._fetch = fetch or self._get

    def _get(self, url: str) -> bytes:
        request = urllib.request.Request(url, headers={"User-Agent": self.user_agent})
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            body = reply.read()
        time.sleep(self.delay)
        return body

    def filings(self, spark: SparkSession, ticker: str, forms=DEFAULT_FORMS, limit: int = 5) -> list[Filing]:
        known = tickers(spark.createDataFrame([(self._fetch(TICKERS_URL).decode(),)], "value string"))
        ticker, cik, _ = resolve(known, ticker)
        body = self._fetch(SUBMISSIONS_URL.format(cik=cik)).decode()
        rows = recent_filings(spark.createDataFrame([(ticker, cik, body)], "ticker string, cik string, value string"), forms, limit)
        return [Filing(**{k: v for k, v in r.asDict().items() if k != "filing_seq"}) for r in rows.orderBy("filing_seq").collect()]

    def download(self, filing: Filing, folder: Path) -> Path:
        suffix = Path(filing.primary_document).suffix or ".html"
        name = "_".join((filing.ticker, filing.form.replace(" ", ""), filing.filing_date, filing.accession_number)) + suffix
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(self._fetch(filing.source_url))
        return folder / name


def ingest(
    spark: SparkSession, client: Client, ticker: str, data_dir: str, store=None, forms=DEFAULT_FORMS, limit: int = 2,
    progress: Callable[[str, int], None] = lambda message, percent: None, again: bool = True,
) -> dict:
    """Download, chunk and store a company's filings; a file that fails is left out and counted.

    Chunk ids are stable, so doing it again replaces. With ``again`` off a company in the store is left as it is.
    """
    if limit < 1:
        raise ValueError("limit is 1 or more")
    if store is not None and not again and store.is_indexed((ticker or "").strip()):
        progress("In the store already", 100)
        have = store.scan(ticker.strip())
        return {"ticker": ticker.strip().upper(), "filings": 0, "failed": [], "chunks": have.count(), "tables": _tables(have)}
    progress("Looking up the company", 5)
    found = client.filings(spark, ticker, forms, limit)
    progress("Found filings", 12)
    saved, failed = [], []
    for i, filing in enumerate(found):
        progress(f"Downloading {filing.form} of {filing.filing_date}", 15 + 55 * i // len(found))
        try:
            saved.append(asdict(filing) | {"local_path": str(client.download(filing, Path(data_dir, "raw")))})
        except OSError as error:
            failed.append((filing.accession_number, str(error)))
            progress(f"Left out {filing.form} of {filing.filing_date}: {error}", 15 + 55 * i // len(found))
    if not saved:
        raise ValueError(f"no filings of {ticker} could be read")
    progress(f"Have {len(saved)} filings", 70)
    symbol = saved[0]["ticker"]
    Path(data_dir, f"{symbol}_filings.json").write_text(json.dumps(saved, indent=2))
    progress("Reading sections and tables", 72)
    chunks = load_corpus(spark, data_dir, symbol).persist()
    told = {"ticker": symbol, "filings": len(saved), "failed": failed, "chunks": chunks.count(), "tables": _tables(chunks)}
    progress(f"Indexing {told['chunks']} chunks ({told['tables']} tables)", 82)
    if store is not None:
        store.upsert(chunks.withColumn("seq", F.struct("source_url", "block_seq")).drop("block_seq"))
    chunks.unpersist()
    progress("Done", 100)
    return told


def _tables(chunks: DataFrame) -> int:
    return chunks.where("chunk_type = 'table'").count()
