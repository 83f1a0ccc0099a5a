"""The engine's operators over the driver's tables, each beside DuckDB SQL for the same rows.

Documents stand for chunks: ``source`` is section and form, ``lang`` the company a question is
scoped to. Vectors join documents by id. Every query reads its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.config import Settings
from gneiss.functions import tables as G
from gneiss.functions import text as T
from gneiss.operators import answer, chunking, evaluate, hybrid, index, latent, lexical, vector, verify
from gneiss.sources import filings, golden, store
from gneiss.sources.tables import read_table as read

#: (qid, question, scope, vector that stands for the question's embedding)
QUESTIONS = (
    ("q1", "Which tionor was eresti about thhere?", "en", 7),
    ("q2", "thhere src6", "en", 14),
    ("q3", "zzzunknown qqqunknown", "en", 21),
    ("q4", "schtz einenkeit verpf src4", "de", 28),
    ("q5", "leaux elle eauouon tionon", "fr", 35),
    ("q6", "What are the tionor src2 amounts of en", "en", 42),
    ("q7", "eresti src6", "en", 49),
    ("q8", "eresti src6 tionor", "xx", 56),
)
#: The tables' vectors are not a text model's, so the distances are wider than the defaults.
SETTINGS = Settings(max_distance=0.85, veto_distance=0.97)


def chunks(spark, sf_dir) -> DataFrame:
    filled = lambda c: F.coalesce(F.col(c), F.lit(""))
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").alias("corpus_pos"), filled("lang").alias("ticker"),
        filled("source").alias("section"), filled("source").alias("form"), filled("text").alias("text"),
    )


def questions(spark) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "qid string, question string, scope string, vec_id long")


def vectors(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("scope"))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return docs.join(rows, docs.doc_id == rows.vec_id).select(
        F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").alias("corpus_pos"), "scope", "embedding"
    )


def hits(spark, sf_dir) -> DataFrame:
    asked = questions(spark).join(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id")
    return vector.nearest(asked, vectors(spark, sf_dir), SETTINGS.candidates, scoped=True)


# -- lexical -------------------------------------------------------------------------------


def tokenize(spark, sf_dir):
    rows = index.tokenized(chunks(spark, sf_dir))
    return rows.select(
        "chunk_id", F.size("terms").cast("long").alias("n_terms"), F.size(F.array_distinct("terms")).cast("long").alias("n_distinct"),
        F.md5(F.array_join("terms", " ")).alias("terms_md5"),
    )


def postings(spark, sf_dir):
    return index.postings(chunks(spark, sf_dir))


def document_frequency(spark, sf_dir):
    return index.document_frequency(index.postings(chunks(spark, sf_dir)))


def corpus_stats(spark, sf_dir):
    rows = index.corpus_stats(index.chunk_lengths(chunks(spark, sf_dir)))
    return rows.withColumn("avg_len", F.round("avg_len", 6))


def scored(spark, sf_dir):
    return lexical.score(questions(spark), index.build(chunks(spark, sf_dir)), SETTINGS)


def _shown(rows):
    return rows.select("qid", "chunk_id", F.round("relevance", 6).alias("relevance"), "gate", F.round("coverage", 6).alias("coverage"), "lex_rank")


def bm25_rank(spark, sf_dir):
    return _shown(scored(spark, sf_dir))


def lexical_gate(spark, sf_dir):
    return _shown(scored(spark, sf_dir).where(lexical.passes_gate(SETTINGS)))


def retrieve_lexical(spark, sf_dir):
    return _shown(lexical.retrieve(questions(spark), index.build(chunks(spark, sf_dir)), 3, SETTINGS))


# -- vectors and fusion --------------------------------------------------------------------


def _near(rows):
    return rows.select("qid", "chunk_id", F.round("distance", 6).alias("distance"), "vec_rank")


def _all_vectors(spark, sf_dir, scope):
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("string").alias("scope"))
    queries = rows.where("vec_id % 100 = 0").select(F.col("vec_id").cast("string").alias("qid"), "embedding", "scope")
    base = rows.select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("vec_id").alias("corpus_pos"), "embedding", "scope")
    return vector.nearest(queries, base, 10, scoped=scope)


def knn_exact(spark, sf_dir):
    return _near(_all_vectors(spark, sf_dir, False))


def knn_scoped(spark, sf_dir):
    return _near(_all_vectors(spark, sf_dir, True))


def vector_floor(spark, sf_dir):
    return _near(vector.within_floor(_all_vectors(spark, sf_dir, False), SETTINGS))


def latent_neighbours(spark, sf_dir):
    """The ten documents nearest to each whose id is divisible by 100, by vectors of latent terms that all documents are fitted for."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("chunk_id"), "text")
    rows = vector.embed(docs, latent.fit(docs)).select("chunk_id", F.col("doc_id").alias("corpus_pos"), "embedding")
    asked = rows.where("corpus_pos % 100 = 0").select(F.col("chunk_id").alias("qid"), "embedding")
    return vector.nearest(asked, rows, 10).select("qid", "chunk_id", F.round("distance", 4).alias("distance"), "vec_rank")


def lexical_veto(spark, sf_dir):
    gated = scored(spark, sf_dir).where(lexical.passes_gate(SETTINGS))
    return _shown(hybrid.lexical_veto(gated, hits(spark, sf_dir), questions(spark), chunks(spark, sf_dir), SETTINGS))


def identifier_exemption(spark, sf_dir):
    asked = questions(spark).select("qid", "scope", T.term_set(F.col("question")).alias("asked"))
    rows = chunks(spark, sf_dir).join(F.broadcast(asked), F.col("ticker") == F.col("scope"))
    named = F.arrays_overlap("asked", index.identifiers(F.col("section"), F.col("form")))
    return rows.where(named).groupBy("qid", "section").agg(F.count(F.lit(1)).alias("chunks"))


def _lists(spark, sf_dir):
    gated = scored(spark, sf_dir).where(lexical.passes_gate(SETTINGS))
    near = hits(spark, sf_dir).where(F.col("distance") <= SETTINGS.max_distance)
    return hybrid._ranked(gated, "lex_rank"), hybrid._ranked(near, "vec_rank")


def rrf_fusion(spark, sf_dir):
    fused = hybrid.fuse(*_lists(spark, sf_dir), SETTINGS)
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return fused.select("qid", "chunk_id", F.round("rrf", 9).alias("rrf"), none("lex_rank"), none("vec_rank"))


def diversify(spark, sf_dir):
    gated, _ = _lists(spark, sf_dir)
    rows = gated.join(chunks(spark, sf_dir).select("chunk_id", "form", "section"), "chunk_id")
    return hybrid.diversify(rows, 8, SETTINGS).select("qid", "chunk_id", "section", "rank")


def evidence(spark, sf_dir):
    return hybrid.retrieve(questions(spark), index.build(chunks(spark, sf_dir)), hits(spark, sf_dir), 3, SETTINGS)


def retrieve_hybrid(spark, sf_dir):
    return evidence(spark, sf_dir).withColumn("rrf", F.round("rrf", 9))


# -- answers -------------------------------------------------------------------------------


def answers(spark, sf_dir):
    return answer.extractive(questions(spark), evidence(spark, sf_dir), chunks(spark, sf_dir), SETTINGS)


def answer_extractive(spark, sf_dir):
    return answers(spark, sf_dir).select(
        "qid", "answer", "supported", F.array_join("citations", "; ").alias("citations"),
        F.size("evidence").cast("long").alias("n_evidence"), "why_it_matters",
    )


def abstain(spark, sf_dir):
    return answers(spark, sf_dir).where("not supported").select("qid", "answer", "why_it_matters")


def why_it_matters(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", T.why_it_matters(F.col("role"), F.col("text")).alias("why"))


def quote_normalize(spark, sf_dir):
    rows = read(spark, sf_dir, "documents")
    return rows.select("doc_id", F.md5(T.normalize_quote(F.col("text"))).alias("norm_md5"))


def quote_verify(spark, sf_dir):
    docs, items = chunks(spark, sf_dir), read(spark, sf_dir, "benchmark")
    n = items.agg(F.count(F.lit(1))).scalar()
    offered = docs.select("chunk_id", F.explode(F.array(*(F.lit(i) for i in range(3)))).alias("pos"), "corpus_pos")
    offered = offered.withColumn("item_id", (F.col("corpus_pos") * 7 + F.col("pos")) % n)
    cited = offered.join(items.select("item_id", F.col("text").alias("quote")), "item_id")
    cited = cited.select(F.lit("q").alias("qid"), "pos", "chunk_id", "quote")
    given = docs.where("ticker = 'en'").select(F.lit("q").alias("qid"), "chunk_id")
    return verify.verify(cited, given, docs).select("chunk_id", "pos", "section", "reason")


def error_describe(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.describe_failure(F.col("text")).alias("reason"))


def prompt(spark, sf_dir):
    return answer.prompts(questions(spark), evidence(spark, sf_dir), chunks(spark, sf_dir)).select("qid", F.md5("prompt").alias("prompt_md5"))


def cost(spark, sf_dir):
    usage = read(spark, sf_dir, "conversations").groupBy(F.concat(F.col("role"), F.lit("-1")).alias("model")).agg(
        F.sum(F.length("text")).alias("input_tokens"), F.count(F.lit(1)).alias("output_tokens")
    )
    rates = spark.createDataFrame([("user", 5e-6, 25e-6), ("assistant", 0.0, 0.0)], "prefix string, input_rate double, output_rate double")
    return answer.format_cost(usage, rates).select("model", "input_tokens", "output_tokens", F.round("cost", 6).alias("cost"), "line")


# -- filings and store ---------------------------------------------------------------------


def first_k_per_form(spark, sf_dir):
    rows = filings.first_of_each(read(spark, sf_dir, "orders"), ["o_orderpriority"], [F.desc("o_orderdate"), "o_orderkey"], 5)
    return rows.select("o_orderpriority", "o_orderkey")


def period_fallback(spark, sf_dir):
    rows = read(spark, sf_dir, "documents")
    return rows.select("doc_id", filings.period(F.when(F.col("lang") == "en", "").otherwise(F.col("lang")), F.col("source")).alias("period"))


def _store_rows(spark, sf_dir):
    return chunks(spark, sf_dir).withColumn("accession_number", F.when(F.col("ticker") == "es", "").otherwise(F.concat("ticker", "section")))


def indexed_companies(spark, sf_dir):
    return store.companies(_store_rows(spark, sf_dir)).withColumn("forms", F.array_join("forms", ","))


def store_stats(spark, sf_dir):
    rows = store.stats(_store_rows(spark, sf_dir))
    return rows.withColumn("forms", F.array_join("forms", ",")).withColumn("tickers", F.array_join("tickers", ","))


def upsert_last_wins(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.concat_ws(":", "source", "lang").alias("chunk_id"), "text", F.col("doc_id").alias("seq"))
    return store.last_wins(rows, first="place").select("chunk_id", "seq", "place", F.length("text").cast("long").alias("n_chars"))


def chunk_id(spark, sf_dir):
    rows = read(spark, sf_dir, "documents")
    section = F.concat(F.lit(" "), F.upper("source"), F.lit(". (Risk) "), F.col("lang"))
    accession = F.when(F.col("lang") == "en", "").otherwise(F.col("lang"))
    return rows.select("doc_id", T.chunk_id(accession, section, F.col("doc_id")).alias("chunk_id"))


# -- HTML and tables -----------------------------------------------------------------------


def html_strip_fallback(spark, sf_dir):
    text = T.strip_html(F.col("html"))
    return read(spark, sf_dir, "pages").select("page_id", F.md5(text).alias("text_md5"), F.length(text).cast("long").alias("n_chars"))


def sentence_windows(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", T.sentence_windows(F.col("text"), 3000).alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n_windows"), F.md5(F.array_join("w", "\n")).alias("windows_md5"))


def html_leaf_blocks(spark, sf_dir):
    rows = chunking.html_events(read(spark, sf_dir, "pages"), "page_id")
    return rows.select("page_id", "seq", "kind", "tag", F.md5("text").alias("text_md5"))


def _line_events(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("seq", "text"))
    return rows.select("doc_id", "seq", F.lit("block").alias("kind"), "text")


def sections(spark, sf_dir):
    rows = chunking.with_sections(_line_events(spark, sf_dir), "doc_id", F.length("text") <= 40)
    return rows.groupBy("doc_id", "run", "section").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))


def caps_headings(spark, sf_dir):
    rows = _line_events(spark, sf_dir).where(T.is_caps_heading(T.collapse(F.col("text")), F.lit("p")))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_headings"))


def item_headings(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.when(F.col("p_size") > 25, "item ").otherwise("Items "), F.col("p_size").cast("string"), F.lit("A. "), F.col("p_name")).alias("h"))
    return rows.select("p_partkey", T.is_item_heading(F.col("h")).alias("is_item"))


def _order_grids(spark, sf_dir, name):
    cells = F.array(name, F.col("l_quantity").cast("int").cast("string"), F.lit("$"), F.concat(F.lit("("), F.col("l_suppkey").cast("string"), F.lit(")")), F.lit(""))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", cells.alias("cells")).alias("r"))
    rows = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    return rows.select("l_orderkey", G.without_fillers(F.transform("rows", lambda r: r["cells"])).alias("rows"))


def data_tables(spark, sf_dir):
    rows = _order_grids(spark, sf_dir, F.concat(F.lit("Line "), F.col("l_returnflag")))
    return rows.select(
        "l_orderkey", G.is_data(F.col("rows")).alias("is_data"), G.numeric_cells(F.col("rows")).cast("long").alias("n_numeric"),
        F.md5(G.render(F.col("rows"))).alias("body_md5"),
    )


def toc_filter(spark, sf_dir):
    name = F.when(F.col("l_returnflag") == "A", "Item 1").when(F.col("l_linenumber") == 7, "Page").otherwise("Total")
    return _order_grids(spark, sf_dir, name).select("l_orderkey", G.is_contents(F.col("rows")).alias("is_contents"))


def chunk_filings(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select(
        F.lit("EXMP").alias("ticker"), F.lit("10-K").alias("form"), F.lit("2026-01-31").alias("filing_date"), F.lit("").alias("period_of_report"),
        F.col("page_id").cast("string").alias("accession_number"), F.concat(F.col("page_id").cast("string"), F.lit("|"), F.col("url")).alias("source_url"), F.col("url").alias("document_name"), "html",
    )
    return chunking.chunk_filings(rows).select("chunk_id", "chunk_index", "chunk_type", "section", F.length("text").alias("n_chars"))


# -- filings made of the tables ------------------------------------------------------------


def made_filings(spark, sf_dir) -> DataFrame:
    """A filing of each supplier: by its key with Item headings, a table of contents, a captioned data table and a
    nested layout table; with headings in capitals; or without headings. Written as a filer's tool would."""
    rows = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    name, nation = F.col("s_name"), F.col("n_name")
    dollars = F.format_number(F.floor(F.abs("s_acctbal")).cast("long"), 0)
    cat = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    contents = "<table><tr><td>Item 1.</td><td>Business</td><td>3</td></tr><tr><td>Item 7A.</td><td>Risk</td><td>9</td></tr><tr><td>ITEM 8.</td><td>Statements</td><td>12</td></tr></table>"
    items = cat(
        "<html><head><style>p {margin: 0}</style></head><body><div>", contents, "</div><p>Front matter of ", name, "</p><h1>Item 1. Business</h1><p>", name,
        " sells parts<br>from <b>", nation, "</b> &amp; elsewhere.</p><!-- note --><div><div>Its customers\u00a0are  many.</div></div>",
        "<h2>item 7A. Market Risk</h2><table><tr><td><p>Balances of ", dollars, " move.</p></td></tr></table><h2>Item 8. Statements</h2><p>BALANCE SHEET of ", name,
        F.repeat(F.lit(", figures in thousands"), 9), "</p><table><tr><td>&nbsp;</td><td>2025</td><td>2024</td></tr><tr><td>Cash</td><td>$</td><td>", dollars,
        "</td><td>—</td></tr><tr><td>Debt</td><td>(</td><td>(12.5)</td><td>3%</td></tr></table><p>After the table.</p><p>No.</p></body></html>",
    )
    capitals = cat("<body><p>Cover</p><p>MARKET RISK OF ", F.upper(nation), "</p><p>", name, " bears risk.</p><ul><li>One</li><li>Two.</li></ul><p>1 2 3</p></body>")
    plain = cat("<script>var x = '<p>';</script><body>Text of ", name, " &amp; its\n<i>nation</i> ", nation, ".</body>")
    html = F.when(F.col("s_suppkey") % 3 == 0, items).when(F.col("s_suppkey") % 3 == 1, capitals).otherwise(plain)
    key = F.col("s_suppkey").cast("string")
    return rows.select(
        F.lit("EXMP").alias("ticker"), F.lit("10-K").alias("form"), F.lit("2026-01-31").alias("filing_date"), F.when(F.col("s_suppkey") % 2 == 0, "").otherwise("2025-12-31").alias("period_of_report"),
        key.alias("accession_number"), F.concat(F.lit("https://x/"), key).alias("source_url"), F.concat(key, F.lit(".htm")).alias("document_name"), html.alias("html"),
    )


def filing_events(spark, sf_dir):
    rows = chunking.html_events(made_filings(spark, sf_dir), "source_url")
    filled = lambda c: F.coalesce(c, F.lit(""))
    return rows.select(
        "source_url", F.col("seq").cast("long").alias("seq"), "kind", "tag", filled(F.col("text")).alias("text"), filled(F.col("title")).alias("title"),
        filled(G.render(F.col("rows"))).alias("grid"),
    )


def contents_dropped(spark, sf_dir):
    return chunking.dropped_contents(chunking.html_events(made_filings(spark, sf_dir), "source_url"), "source_url")


def filing_chunks(spark, sf_dir):
    rows = chunking.chunk_filings(made_filings(spark, sf_dir))
    return rows.select("chunk_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_type", "table_title", "section", "text", "period_of_report", "document_name")


def filing_tables(spark, sf_dir):
    return store.table_counts(chunking.chunk_filings(made_filings(spark, sf_dir)))


def recent_filings(spark, sf_dir):
    """The registry's JSON of each customer's orders, as it publishes a company's filings."""
    rows = read(spark, sf_dir, "orders")
    names = ("form", "accessionNumber", "primaryDocument", "filingDate", "reportDate")
    key, date = F.format_string("%010d", "o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    number = F.concat(key, F.lit("-"), F.substring(date, 3, 2), F.lit("-1"))
    values = (F.substring("o_orderpriority", 3, 99), number, F.concat(key, F.lit(".htm")), date, F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(date))
    listed = rows.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", *(v.alias(n) for n, v in zip(names, values, strict=True))))).alias("f"))
    recent = F.struct(F.struct(*(F.col("f")[n].alias(n) for n in names)).alias("recent"))
    cik = F.format_string("%010d", F.col("o_custkey") + 1)
    body = listed.select(F.concat(F.lit("T"), F.col("o_custkey")).alias("ticker"), cik.alias("cik"), F.to_json(F.struct(recent.alias("filings"))).alias("value"))
    found = filings.recent_filings(body, ("URGENT", "LOW"), 2)
    return found.select("ticker", "form", "filing_date", "accession_number", "source_url", "period_of_report", F.col("filing_seq").cast("long").alias("filing_seq"))


def ticker_map(spark, sf_dir):
    """The registry's map of tickers, one JSON document for each customer."""
    number = F.col("c_custkey").cast("long") * 999_999_937 % 10_000_000_000
    title = F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_name"))
    entry = F.struct(number.alias("cik_str"), F.lower("c_name").alias("ticker"), title.alias("title"))
    rows = read(spark, sf_dir, "customer").select(F.to_json(F.create_map(F.col("c_custkey").cast("string"), entry)).alias("value"))
    return filings.tickers(rows)


def ticker_syntax(spark, sf_dir):
    raw = F.concat(F.lit(" "), F.coalesce("lang", F.lit("")), F.when(F.col("doc_id") % 3 == 0, "-b").when(F.col("doc_id") % 3 == 1, " b").otherwise(F.col("doc_id").cast("string")))
    return read(spark, sf_dir, "documents").select("doc_id", T.normalize_ticker(raw).alias("ticker"), T.is_ticker(raw).alias("is_ticker"))


def whitespace_clean(spark, sf_dir):
    odd = F.replace(F.replace("text", F.lit("the"), F.lit("the\u200b")), F.lit(" la "), F.lit("\u00a0la\t\n"))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean(odd)).alias("clean_md5"))


def metadata_coercion(spark, sf_dir):
    rows = read(spark, sf_dir, "events")
    return rows.select(*(T.metadata_value(F.col(c)).alias(c) for c, kind in rows.dtypes if kind in ("bigint", "int", "string")))


def token_totals(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select(F.when(F.col("role") == "user", F.length("text")).alias("input_tokens"), F.col("turn").alias("output_tokens"))
    return evaluate.token_totals(rows)


def failure_reasons(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").select(T.describe_failure(F.when(F.col("toxic") == 1, "429").when(F.col("quality") == 0, "503")).alias("generation_error"))
    return evaluate.failure_reasons(rows).select(F.array_join("reasons", "; ").alias("reasons"))


def golden_filters(spark, sf_dir):
    facts = F.when(F.col("doc_id") % 4 == 0, F.array("source")).when(F.col("doc_id") % 4 == 1, F.array().cast("array<string>"))
    rows = read(spark, sf_dir, "documents").select("doc_id", (F.col("lang") == "en").alias("portable"), facts.alias("expect_answer_contains"))
    chosen, home = golden.select_cases(rows, "AAAA", "bbbb", only_checkable=True)
    return chosen.select("doc_id", F.lit(home).alias("at_home"))


def upsert_anti_join(spark, sf_dir):
    """Chunks of a store that a batch of newer ones does not replace."""
    old = read(spark, sf_dir, "documents").select(F.concat_ws(":", "source", F.pmod("doc_id", F.lit(7)).cast("string")).alias("chunk_id"), "text", F.col("doc_id").alias("seq"))
    new = store.last_wins(old.where("seq % 2 = 0"))
    return store.last_wins(store.not_replaced(old, new)).select("chunk_id", "seq")


# -- evaluation ----------------------------------------------------------------------------


def _cases(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    rows = labels.join(docs, "doc_id")
    answered = F.col("toxic") == 0
    return rows.select(
        F.col("doc_id").cast("string").alias("qid"), "doc_id", "lang", (F.col("quality") == 1).alias("expected"), answered.alias("answered"),
        ((F.col("quality") == 1) == answered).alias("correct"), (F.col("lang") == "es").alias("known_gap"), (F.col("n_chars") > 500).alias("cited"),
        evaluate.section_hit(F.when(F.col("lang") != "fr", F.lit("src1")), answered, F.array("source", "lang")).alias("section_hit"),
        evaluate.fact_hit(F.when(F.col("lang") != "de", F.array(F.lit("TIONOR"), F.lit("elle"))), F.col("lang") != "es", answered, F.col("text")).alias("fact_hit"),
        (F.col("lang") == "en").alias("generated"), F.col("toxic").cast("long").alias("rejected_quotes"),
    )


def scorecard(spark, sf_dir):
    return evaluate.scorecard(_cases(spark, sf_dir))


def fact_check(spark, sf_dir):
    return _cases(spark, sf_dir).select("doc_id", F.coalesce(F.col("fact_hit").cast("string"), F.lit("unchecked")).alias("fact_hit"))


def section_hit(spark, sf_dir):
    return _cases(spark, sf_dir).select("doc_id", F.coalesce(F.col("section_hit").cast("string"), F.lit("unchecked")).alias("section_hit"))


def baseline_delta(spark, sf_dir):
    rows = _cases(spark, sf_dir)
    delta = evaluate.baseline_delta(evaluate.scorecard(rows), evaluate.scorecard(rows.where("lang = 'en'")))
    return delta.select("label", "was", "now", "delta", "arrow")


def contrast(spark, sf_dir):
    asked = questions(spark)
    expected = asked.select("qid", (F.col("qid") != "q3").alias("expected"))
    alone = lexical.retrieve(asked, index.build(chunks(spark, sf_dir)), 3, SETTINGS)
    return evaluate.contrast(expected, alone, evidence(spark, sf_dir))


def score_cases(spark, sf_dir):
    """Reviewed cases and their answers, one for each labelled document, scored side by side."""
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents"), "doc_id").withColumn("qid", F.col("doc_id").cast("string"))
    none = F.lit(None).cast("string")
    cases = rows.select(
        "qid", F.col("source").alias("question"), F.when(F.col("quality") == 1, "supported").otherwise("abstain").alias("expect"),
        F.when(F.col("lang") == "es", True).alias("known_gap"), F.when(F.col("lang") == "es", "stated elsewhere").alias("gap_class"),
        F.when(F.col("lang") != "fr", "src1").alias("expect_section_contains"), F.lit(None).cast("boolean").alias("section_known_gap"),
        F.when(F.col("lang") != "de", F.array(F.lit("TIONOR"), F.lit("elle"))).alias("expect_answer_contains"),
    )
    shown = F.struct(F.col("source").alias("section"), none.alias("form"), none.alias("filing_date"), none.alias("excerpt"), none.alias("source_url"))
    said = rows.where("toxic = 0 or doc_id % 2 = 0").select(
        "qid", F.col("source").alias("question"), F.col("text").alias("answer"), (F.col("toxic") == 0).alias("supported"),
        F.when(F.col("n_chars") > 500, F.array("lang")).otherwise(F.array().cast("array<string>")).alias("citations"),
        F.array(shown).alias("evidence"), (F.col("lang") == "en").alias("generated"), F.lit("").alias("generation_error"),
    )
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unchecked")).alias(c)
    scored = evaluate.score_cases(cases, said)
    return scored.select("qid", "expected", "answered", "correct", "known_gap", "gap_class", "cited", told("section_hit"), told("fact_hit"), "section_known_gap")


def partial_run(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")
    sums = rows.groupBy("source").agg(F.count_if(F.col("lang") == "en").alias("reached"), F.count(F.lit(1)).alias("cases"), F.count_if(F.col("toxic") == 1).alias("errors"))
    return sums.select("source", evaluate.is_partial_run(F.col("reached"), F.col("cases"), F.col("errors")).alias("partial"))


def chunk_key(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.col("doc_id").cast("string")).alias("chunk_id"),
        F.coalesce("lang", F.lit("")).alias("source_url"), F.coalesce("source", F.lit("")).alias("section"), F.col("doc_id").cast("int").alias("chunk_index"),
    )
    return hybrid.keyed(rows).select("doc_id", "chunk_id")


def percent(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    rows = rows.groupBy("source").agg(F.sum("toxic").alias("part"), F.sum("quality").alias("whole"))
    return rows.select("source", T.percent(F.col("part"), F.col("whole")).alias("share"))


QUERIES = {f.__name__: f for f in (
    tokenize, postings, document_frequency, corpus_stats, bm25_rank, lexical_gate, retrieve_lexical, knn_exact, knn_scoped, vector_floor, latent_neighbours,
    lexical_veto, identifier_exemption, rrf_fusion, diversify, retrieve_hybrid, answer_extractive, abstain, why_it_matters, quote_normalize,
    quote_verify, error_describe, prompt, cost, first_k_per_form, period_fallback, indexed_companies, store_stats, upsert_last_wins, chunk_id,
    html_strip_fallback, sentence_windows, html_leaf_blocks, sections, caps_headings, item_headings, data_tables, toc_filter, chunk_filings,
    filing_events, contents_dropped, filing_chunks, filing_tables, recent_filings, ticker_map, ticker_syntax, whitespace_clean, metadata_coercion,
    token_totals, failure_reasons, golden_filters, upsert_anti_join,
    scorecard, fact_check, section_hit, baseline_delta, contrast, percent, score_cases, partial_run, chunk_key,
)}
