"""Schemas of the engine's tables."""

from __future__ import annotations

FILING = (
    "ticker string, cik string, form string, filing_date string, accession_number string, "
    "primary_document string, source_url string, period_of_report string"
)
SAVED_FILING = FILING + ", local_path string"
CHUNK = (
    "chunk_id string, chunk_index int, chunk_type string, table_title string, ticker string, form string, "
    "filing_date string, period_of_report string, accession_number string, section string, text string, "
    "source_url string, document_name string"
)
#: What a store adds to a chunk: its terms, its vector (null without an embedder) and its place in the corpus.
STORED = CHUNK + ", terms array<string>, embedding array<float>, corpus_pos long"
CHUNK_COLUMNS = [c.split()[0] for c in CHUNK.split(", ")]
METADATA_COLUMNS = [c for c in CHUNK_COLUMNS if c not in ("chunk_id", "text")]
TICKER_MAP = "map<string, struct<cik_str: bigint, ticker: string, title: string>>"
SUBMISSIONS = (
    "struct<filings: struct<recent: struct<form: array<string>, accessionNumber: array<string>, "
    "primaryDocument: array<string>, filingDate: array<string>, reportDate: array<string>>>>"
)
CITATION = "struct<chunk_id: string, quote: string>"
ANSWER = f"supported boolean, answer string, citations array<{CITATION}>, reason_if_unsupported string"
USAGE = (
    "struct<input_tokens: bigint, output_tokens: bigint, cache_read_tokens: bigint, cache_write_tokens: bigint, "
    "model: string>"
)
EVIDENCE = "struct<section: string, form: string, filing_date: string, excerpt: string, source_url: string>"
GOLDEN_CASE = (
    "question string, expect string, why string, portable boolean, expect_answer_contains array<string>, "
    "expect_section_contains string, form_hint string, question_class string, lexical_alone string, "
    "known_gap boolean, known_gap_without_generation boolean, gap_class string, gap_reason string, "
    "gap_reason_resolved string, section_known_gap boolean, section_gap_reason string"
)
GOLDEN_SET = (
    "_about array<string>, corpus struct<ticker: string, forms: array<string>, note: string>, "
    f"cases array<struct<{', '.join(c.replace(' ', ': ', 1) for c in GOLDEN_CASE.split(', '))}>>"
)
