"""Chunking, filings, store and streaming on inline documents."""

import json

import pytest
from pyspark.sql import functions as F

from gneiss.operators import chunking, index
from gneiss.schemas import CHUNK
from gneiss.sources import filings
from gneiss.sources.store import Store, companies, last_wins, stats
from gneiss.streaming.ingest import ARRIVING, stream_filings

NAMES = [c.split()[0] for c in ARRIVING.split(", ")]


def filing(html, url="https://x/1", **more):
    base = dict(zip(NAMES, ("EXMP", "10-K", "2026-02-01", "", "0001-26-1", url, "f.htm", html), strict=True))
    return base | more


def chunks_of(spark, *rows, **how):
    frame = spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rows], ARRIVING)
    return chunking.chunk_filings(frame, **how).orderBy("source_url", "block_seq").collect()


TABLE = """<html><body><div><table><tr><th>Part I</th><th>Fleet</th></tr><tr><td>Item 2.</td><td>Harbours</td></tr><tr><td>item 5.</td><td>Crews</td></tr>
<tr><td>Part II</td><td>Yards</td></tr></table></div><h3>Item 5. Ships and Crews</h3><p>Ships in service by harbour, in tonnes</p>
<table><tr><th>Harbour</th><th>Ferries</th><th>Tugs</th></tr><tr><td>North quay</td><td>7,410</td><td>|</td><td>865.5</td></tr>
<tr><td>Old dock</td><td>(</td><td>(92)</td><td>4%</td></tr><tr><td>*</td></tr></table><p>Tugs are leased.</p></body></html>"""


def test_sections(spark):
    rows = chunks_of(spark, filing("<p>front matter</p><h1>Item 1. Business</h1><p>We make things.</p><p>No.</p><h2>Item 7A. Market Risk</h2><p>Rates move.</p>"))
    assert [(r.section, r.text, r.chunk_id) for r in rows] == [
        ("Item 1. Business", "We make things. No.", "0001-26-1:item-1-business:0"), ("Item 7A. Market Risk", "Rates move.", "0001-26-1:item-7a-market-risk:0"),
    ]
    assert {r.period_of_report for r in rows} == {"2026-02-01"} and {r.chunk_type for r in rows} == {"text"}


def test_tables_are_chunks_and_contents_go(spark):
    rows = chunks_of(spark, filing(TABLE))
    assert [(r.chunk_type, r.chunk_index) for r in rows] == [("text", 0), ("table", 1), ("text", 2)] and {r.section for r in rows} == {"Item 5. Ships and Crews"}
    assert rows[1].table_title.endswith("Ships in service by harbour, in tonnes") and rows[2].text == "Tugs are leased."
    assert rows[1].text.split("\n")[-3:] == ["Harbour | Ferries | Tugs", "North quay | 7,410 | 865.5", "Old dock | (92) | 4%"]


def test_headings_in_cells_inline_bodies_and_leaves(spark):
    rows = chunks_of(spark, filing("<div><div><p>Item 2. Properties</p><p>text once</p>lost direct text</div></div><table><tr><td>Item 3. Legal</td></tr><tr><td>None.</td></tr></table>"))
    assert [(r.section, r.text) for r in rows] == [("Item 2. Properties", "text once"), ("Item 3. Legal", "None.")]
    unclosed = chunks_of(spark, filing("<h1>Item 1. Business</h1><p>outer<p>inner text</p>"))
    assert [r.text for r in unclosed] == ["inner text"]


def test_capitals_then_whole_text(spark):
    proxy = "<p>TABLE OF CONTENTS</p><p>EXECUTIVE COMPENSATION</p><p>We pay people.</p><td>ALL CURRENT DIRECTORS AS A GROUP</td><p>AUDIT COMMITTEE REPORT</p><p>It met often.</p>"
    assert [r.section for r in chunks_of(spark, filing(proxy))] == ["EXECUTIVE COMPENSATION", "AUDIT COMMITTEE REPORT"]
    mixed = "<h1>Item 8. Data</h1><p>BALANCE SHEETS OF THE COMPANY</p><p>text here</p>"
    assert [r.section for r in chunks_of(spark, filing(mixed))] == ["Item 8. Data"]
    plain = chunks_of(spark, filing("<script>x</script><p>" + "A sentence of words &amp; more. " * 300 + "</p>"))
    assert {r.section for r in plain} == {"Document"} and len(plain) > 2 and all(len(r.text) <= 3000 for r in plain)
    assert sum(len(r.text) for r in plain) > 5000 and "&amp;" in plain[0].text
    assert chunks_of(spark, filing("<h1>Item 1. X</h1><p>No</p>")) == [] and chunks_of(spark, filing("")) == []


def test_repeated_slugs(spark):
    page = "<h1>Item 1. Business</h1><p>first part</p><h1>ITEM 1. BUSINESS</h1><p>second part</p>"
    assert len({r.chunk_id for r in chunks_of(spark, filing(page))}) == 1
    assert [r.chunk_id[-1] for r in chunks_of(spark, filing(page), slug_index=True)] == ["0", "1"]


TICKERS = json.dumps({"0": {"cik_str": 123, "ticker": "EXMP", "title": "Example Corp"}, "1": {"cik_str": 45678901234, "ticker": "big", "title": ""}})
RECENT = {"form": ["10-Q", "4", "10-K", "10-Q", "10-Q"], "accessionNumber": ["a-5", "a-4", "a-3", "a-2", "a-1"], "primaryDocument": ["5.htm", "4.htm", "3.htm", "2", "1.htm"], "filingDate": ["d5", "d4", "d3", "d2", "d1"], "reportDate": ["r5", "", ""]}


def test_registry(spark):
    known = filings.tickers(spark.createDataFrame([(TICKERS,)], "value string"))
    assert {tuple(r) for r in known.collect()} == {("EXMP", "0000000123", "Example Corp"), ("BIG", "45678901234", "BIG")}
    assert filings.resolve(known, " exmp ")[1] == "0000000123"
    for bad in ("", "not a ticker", "NONE"):
        with pytest.raises(ValueError):
            filings.resolve(known, bad)
    body = json.dumps({"filings": {"recent": RECENT}})
    rows = filings.recent_filings(spark.createDataFrame([("EXMP", "0000000123", body)], "ticker string, cik string, value string"), limit_per_form=2).orderBy("filing_seq").collect()
    assert [(r.accession_number, r.period_of_report) for r in rows] == [("a-5", "r5"), ("a-3", "d3"), ("a-2", "d2")]
    assert rows[0].source_url == "https://www.sec.gov/Archives/edgar/data/123/a5/5.htm"


def replies(url):
    if url == filings.TICKERS_URL:
        return TICKERS.encode()
    if "submissions" in url:
        return json.dumps({"filings": {"recent": RECENT}}).encode()
    if url.endswith("3.htm"):
        raise OSError("gone")
    return b"<h1>Item 1. Business</h1><p>We make \xff things.</p>"


def test_ingest(spark, tmp_path):
    with pytest.raises(ValueError):
        filings.Client("agent")
    client = filings.Client("someone someone@somewhere.org", fetch=replies)
    steps = []
    store = Store(spark, str(tmp_path / "store"))
    told = filings.ingest(spark, client, "exmp", str(tmp_path), store, progress=lambda message, percent: steps.append(percent))
    assert told["filings"] == 2 and len(told["failed"]) == 1 and told["chunks"] == 2
    assert steps == sorted(steps) and steps[-1] == 100 and store.is_indexed("EXMP") and not store.is_indexed("NOPE")
    again = filings.ingest(spark, client, "exmp", str(tmp_path), store)
    assert again["chunks"] == 2 and store.scan().count() == 2


def rows_of(spark, *rows):
    full = [(c, 0, "text", "", t, f, "d", "p", a, "s", x, "u", "n", i) for i, (c, t, f, a, x) in enumerate(rows)]
    return spark.createDataFrame(full, CHUNK + ", seq int")


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.scan().count() == 0 and stats(store.scan()).first().chunks == 0
    assert store.upsert(rows_of(spark, ("1", "AAAA", "10-K", "x", "one"), ("2", "AAAA", "10-Q", "y", "two"), ("1", "AAAA", "10-K", "x", "one again"), ("", "AAAA", "", "", "no id"), ("9", "AAAA", "", "", "  "))) == 2
    assert store.upsert(rows_of(spark, ("3", "BBBB", "8-K", "", "three"))) == 3
    assert store.upsert(rows_of(spark, ("2", "AAAA", "10-Q", "y", "two changed"))) == 3
    assert {(r.chunk_id, r.text, r.corpus_pos) for r in store.scan("aaaa").collect()} == {("1", "one again", 0), ("2", "two changed", 1)}
    plan = store.scan("AAAA")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "AAAA" in plan
    assert {tuple(r[:3]) for r in companies(store.scan()).collect()} == {("AAAA", 2, 2), ("BBBB", 1, 0)}
    assert stats(store.scan()).first().tickers == ["AAAA", "BBBB"]
    assert store.upsert(rows_of(spark, ("7", "AAAA", "10-Q", "y", "seven")), replace_filings=True) == 3
    assert Store(spark, str(tmp_path / "s"), reset=True).scan().count() == 0


def test_last_wins(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("a", "y", 3), ("b", "z", 2), (None, "q", 1), ("c", None, 1)], "chunk_id string, text string, seq int")
    assert {tuple(r) for r in last_wins(rows).collect()} == {("a", "y", 3), ("b", "z", 2)}


def test_stream(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    inbox = tmp_path / "in"
    inbox.mkdir()

    def add(name, *rows):
        (inbox / name).write_text("\n".join(map(json.dumps, rows)))
        query = stream_filings(spark, str(inbox), store, str(tmp_path / "cp"))
        query.awaitTermination(120)

    page = filing("<h1>Item 1. Business</h1><p>We make things.</p>")
    add("1.json", page)
    assert store.scan().count() == 1
    add("2.json", page, filing("<h1>Item 2. Sites</h1><p>We have two.</p>", url="https://x/2", accession_number="0002"))
    assert {r.section for r in store.scan("EXMP").collect()} == {"Item 1. Business", "Item 2. Sites"} and store.scan().count() == 2
    # The first page came twice: what its first chunk added to the counts was taken off again.
    df = store.index().differences.groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
    assert {tuple(r) for r in df.collect()} == {tuple(r) for r in index.document_frequency(index.postings(store.scan())).select("term", "df").collect()}
    assert store.index().totals.agg(F.sum("n_docs")).first()[0] == 2


def test_embedded_columns(spark):
    from gneiss.operators.vector import HashedTerms, embed

    rows = embed(spark.createDataFrame([("a b",), (None,)], "text string"), HashedTerms(16))
    assert sorted(sum(abs(x) for x in r.embedding) for r in rows.collect()) == [0.0, 2.0]
    assert rows.select(F.size("embedding")).distinct().count() == 1
