"""DuckDB SQL for the rows of gneiss.plans.queries, written for the tables and not from the plans."""

from __future__ import annotations

from gneiss.functions.text import FAILURES, HEADING_NOISE, STOP_WORDS, TRY_BROADER, UNSUPPORTED_ANSWER, WHY
from gneiss.plans.queries import QUESTIONS, SETTINGS


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


STOP = "[" + ", ".join(map(_text, STOP_WORDS)) + "]"
ASKED = ", ".join(f"({_text(q)}, {_text(s)}, {_text(c)}, {v})" for q, s, c, v in QUESTIONS)


def _terms(column: str) -> str:
    stem = "CASE WHEN t LIKE '%s' AND t NOT LIKE '%ss' THEN left(t, length(t) - 1) ELSE t END"
    return (
        f"list_filter(list_transform(list_filter(regexp_extract_all(lower({column}), '[a-z0-9]+'), lambda t: NOT list_contains({STOP}, t)), "
        f"lambda t: {stem}), lambda t: length(t) > 2 AND NOT list_contains({STOP}, t))"
    )


CHUNKS = f"""
questions(qid, question, scope, vec_id) AS (VALUES {ASKED}),
chunks AS (
  SELECT CAST(doc_id AS VARCHAR) AS chunk_id, doc_id AS corpus_pos, coalesce(lang, '') AS ticker, coalesce(source, '') AS section,
         coalesce(source, '') AS form, coalesce(text, '') AS text FROM documents
),
tokens AS (SELECT chunk_id, corpus_pos, ticker AS scope, {_terms("text")} AS terms FROM chunks),
post AS (SELECT scope, chunk_id, term, count(*) AS tf FROM (SELECT scope, chunk_id, unnest(terms) AS term FROM tokens) GROUP BY ALL),
freq AS (SELECT scope, term, count(*) AS df FROM post GROUP BY ALL),
stat AS (SELECT scope, count(*) AS n_docs, CASE WHEN avg(len(terms)) = 0 THEN 1 ELSE avg(len(terms)) END AS avg_len FROM tokens GROUP BY scope),
asked AS (SELECT qid, scope, list_distinct({_terms("question")}) AS terms FROM questions),
wanted AS (
  SELECT qid, scope, term, len(list_filter(terms, lambda t: t <> lower(scope))) AS n FROM (SELECT *, unnest(terms) AS term FROM asked) WHERE term <> lower(scope)
),
heads AS (SELECT DISTINCT chunk_id, ticker AS scope, unnest({_terms("section")}) AS term FROM chunks),
"""
SCORED = CHUNKS + """
parts AS (
  SELECT qid, chunk_id, term, 1 AS in_text, 0 AS in_section,
         ln(1 + (n_docs - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE))) * tf * CAST(2.5 AS DOUBLE)
         / (tf + CAST(1.5 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * greatest(len(terms), 1) / avg_len)) AS part, n
  FROM wanted JOIN post USING (scope, term) JOIN freq USING (scope, term) JOIN stat USING (scope) JOIN tokens USING (scope, chunk_id)
  UNION ALL
  SELECT qid, chunk_id, term, 0, 1, CAST(2 AS DOUBLE), n FROM wanted JOIN heads USING (scope, term)
),
summed AS (
  SELECT qid, chunk_id, CAST(chunk_id AS BIGINT) AS corpus_pos, round(sum(part), 9) AS relevance, CAST(sum(in_text) + 2 * sum(in_section) AS INT) AS gate,
         count(DISTINCT term) / CAST(max(n) AS DOUBLE) AS coverage FROM parts GROUP BY qid, chunk_id
),
scored AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY relevance DESC, corpus_pos) AS INT) AS lex_rank FROM summed),
gated AS (SELECT * FROM scored WHERE gate >= 2 AND coverage >= 0.6),
"""
HITS = f"""
pool AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, doc_id AS corpus_pos, coalesce(lang, '') AS scope, CAST(embedding AS DOUBLE[]) AS e
         FROM documents JOIN embeddings ON doc_id = vec_id),
dist AS (
  SELECT qid, chunk_id, corpus_pos, round(list_cosine_distance(p.e, CAST(v.embedding AS DOUBLE[])), 12) AS distance
  FROM questions q JOIN embeddings v ON v.vec_id = q.vec_id JOIN pool p ON p.scope = q.scope
),
hits AS (
  SELECT qid, chunk_id, distance, CAST(row_number() OVER (PARTITION BY qid ORDER BY distance, corpus_pos) AS INT) AS vec_rank FROM dist
  QUALIFY row_number() OVER (PARTITION BY qid ORDER BY distance, corpus_pos) <= 10
),
near AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY vec_rank) AS rank FROM hits WHERE distance <= {SETTINGS.max_distance}),
vetoed AS (
  SELECT g.* FROM gated g JOIN chunks c USING (chunk_id) JOIN asked a USING (qid) LEFT JOIN hits h USING (qid, chunk_id)
  WHERE g.qid NOT IN (SELECT qid FROM hits) OR coalesce(h.distance, 1) <= {SETTINGS.veto_distance}
     OR list_has_any(a.terms, {_terms("c.section || ' ' || c.form")})
),
"""


def _fused(lists: str) -> str:
    return f"""
fused AS (
  SELECT qid, chunk_id, round(sum(1 / CAST(60 + rank AS DOUBLE)), 12) AS rrf, CAST(min(l) AS INT) AS lex_rank, CAST(min(v) AS INT) AS vec_rank FROM (
    SELECT qid, chunk_id, rank, rank AS l, NULL AS v FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY lex_rank) AS rank FROM {lists})
    UNION ALL SELECT qid, chunk_id, rank, NULL, rank FROM near) GROUP BY qid, chunk_id
)"""


EVIDENCE = SCORED + HITS + _fused("vetoed") + """,
ordered AS (
  SELECT f.*, section, form, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, lex_rank NULLS LAST, vec_rank NULLS LAST) AS place FROM fused f JOIN chunks USING (chunk_id)
),
capped AS (SELECT *, row_number() OVER (PARTITION BY qid, form, section ORDER BY place) > 2 AS over FROM ordered),
evidence AS (
  SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY over, place) AS INT) AS rank, chunk_id, rrf FROM capped
  QUALIFY row_number() OVER (PARTITION BY qid ORDER BY over, place) <= 3
)
"""
SHOWN = "SELECT qid, chunk_id, round(relevance, 6) AS relevance, gate, round(coverage, 6) AS coverage, lex_rank FROM "


def _why(section: str, question: str) -> str:
    t = f"lower({section} || ' ' || {question})"
    return (
        f"CASE WHEN contains({t}, 'risk') THEN {_text(WHY['risk'])} WHEN regexp_matches({t}, 'business|product|customer') THEN {_text(WHY['business'])} "
        f"WHEN regexp_matches({t}, 'financial|revenue|cash') THEN {_text(WHY['financial'])} ELSE {_text(WHY['default'])} END"
    )


_PLAIN_MARKS = """translate(coalesce({}, ''), '’‘“”–—−', '''''""---')"""


def _norm(c: str) -> str:
    return "lower(trim(regexp_replace(" + _PLAIN_MARKS.format(c) + r", '[\s\x0B\x1C-\x1F\x85\xA0]+', ' ', 'g')))"


ANSWERS = EVIDENCE.rstrip() + f""",
found AS (
  SELECT qid, first(section ORDER BY rank) AS section, first(text ORDER BY rank) AS text, count(*) AS n,
         string_agg(section || ' | ' || form || ' |  | ', '; ' ORDER BY rank) AS citations FROM evidence JOIN chunks USING (chunk_id) GROUP BY qid
),
answers AS (
  SELECT q.qid, CASE WHEN n IS NULL THEN {_text(UNSUPPORTED_ANSWER)}
                ELSE 'Based on ' || section || ' and related filing text, the company states: ' || left(text, 300) END AS answer,
         n IS NOT NULL AS supported, coalesce(citations, '') AS citations, coalesce(n, 0) AS n_evidence,
         CASE WHEN n IS NULL THEN {_text(TRY_BROADER)} ELSE {_why("section", "question")} END AS why_it_matters
  FROM questions q LEFT JOIN found USING (qid)
)
"""


def _knn(condition: str) -> str:
    return f"""
WITH d AS (
  SELECT CAST(q.vec_id AS VARCHAR) AS qid, CAST(v.vec_id AS VARCHAR) AS chunk_id, v.vec_id AS pos,
         round(list_cosine_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 12) AS distance
  FROM embeddings q JOIN embeddings v ON {condition} WHERE q.vec_id % 100 = 0
)
SELECT qid, chunk_id, round(distance, 6) AS distance, CAST(row_number() OVER (PARTITION BY qid ORDER BY distance, pos) AS INT) AS vec_rank FROM d
QUALIFY row_number() OVER (PARTITION BY qid ORDER BY distance, pos) <= 10
"""


_SLUG = "coalesce(nullif(regexp_replace(regexp_replace(lower(s), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'document')"
_STORE = "(SELECT *, CASE WHEN lang = 'es' THEN '' ELSE lang || source END AS acc FROM documents)"
_FAIL = dict(FAILURES)


def _grids(name: str) -> str:
    return f"""
WITH cells AS (
  SELECT l_orderkey, l_linenumber, [{name}, CAST(CAST(l_quantity AS INT) AS VARCHAR), '(' || l_suppkey || ')'] AS row FROM lineitem
), grids AS (SELECT l_orderkey, list(row ORDER BY l_linenumber, row) AS rows FROM cells GROUP BY l_orderkey),
judged AS (
  SELECT *, flatten(rows) AS flat,
    contains(lower(array_to_string(flatten(rows), ' ')), 'table of contents') OR len(list_filter(rows, lambda r: lower(r[1]) = 'page')) > 0
    OR len(list_filter(rows, lambda r: regexp_matches(r[1], '(?i)^(item|part)\\b'))) >= greatest(3, len(rows) // 2) AS is_contents FROM grids
)
"""


_CASES = """
WITH rows AS (
  SELECT d.doc_id, lang, quality = 1 AS expected, toxic = 0 AS answered, (quality = 1) = (toxic = 0) AS correct, lang = 'es' AS known_gap, n_chars > 500 AS cited,
    CASE WHEN lang <> 'fr' AND toxic = 0 THEN contains(source, 'src1') OR contains(lang, 'src1') END AS section_hit,
    CASE WHEN lang <> 'de' AND lang <> 'es' AND toxic = 0 THEN contains(lower(coalesce(text, '')), 'tionor') OR contains(lower(coalesce(text, '')), 'elle') END AS fact_hit,
    lang = 'en' AS generated, toxic AS rejected_quotes
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id
)
"""


def _card(where: str = "true") -> str:
    return f"""SELECT count(*) AS cases, count(*) FILTER (expected AND correct) AS answered_when_expected, count(*) FILTER (expected) AS answered_total,
  count(*) FILTER (NOT expected AND correct) AS declined_when_expected, count(*) FILTER (NOT expected) AS declined_total, count(*) FILTER (correct) AS correct,
  count(*) FILTER (answered AND cited) AS cited_when_answered, count(*) FILTER (answered) AS answers, count(*) FILTER (section_hit) AS section_hits,
  count(section_hit) AS section_checked, count(*) FILTER (fact_hit) AS fact_hits, count(fact_hit) AS fact_checked, count(*) FILTER (generated) AS reached_model,
  CAST(coalesce(sum(rejected_quotes), 0) AS BIGINT) AS rejected_quotes, count(*) FILTER (known_gap AND NOT correct) AS open_gaps,
  count(*) FILTER (known_gap) AS gaps_recorded FROM rows WHERE {where}"""


_NOISE = ", ".join(map(_text, HEADING_NOISE))
_LINES = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS seq FROM documents
)"""
_W = "length(a.open) + length(x.open) + 1 <= 3000"
_JOINED = f"(CASE WHEN a.open = '' THEN x.open WHEN {_W} THEN a.open || ' ' || x.open ELSE x.open END)"
_DONE = f"(CASE WHEN a.open <> '' AND NOT ({_W}) THEN list_append(a.done, a.open) ELSE a.done END)"
_CUTS = f"greatest(CAST(ceil(length({_JOINED}) / 3000.0) AS INT) - 1, 0)"

# What the filings of made_filings say, written down without their markup. seq, kind, tag, text, title, grid of each event.
_MADE = """
WITH f AS (SELECT s_suppkey AS k, 'https://x/' || s_suppkey AS source_url, s_name AS n, n_name AS c, format('{:,}', CAST(floor(abs(s_acctbal)) AS BIGINT)) AS d,
  CASE WHEN s_suppkey % 2 = 0 THEN '2026-01-31' ELSE '2025-12-31' END AS period_of_report, s_suppkey || '.htm' AS document_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
g AS (SELECT *, 'BALANCE SHEET of ' || n || repeat(', figures in thousands', 9) AS sheet, '2025 | 2024' || chr(10) || 'Cash | ' || d || chr(10) || 'Debt | (12.5) | 3%' AS grid FROM f)
"""
_SAID = _MADE + """,
e AS (
  SELECT k, source_url, unnest([
    ['contents', 'table', '', '', ''], ['block', 'p', 'Front matter of ' || n, '', ''], ['block', 'h1', 'Item 1. Business', '', ''],
    ['block', 'p', n || ' sells parts from ' || c || ' & elsewhere.', '', ''], ['block', 'div', 'Its customers are many.', '', ''], ['block', 'h2', 'item 7A. Market Risk', '', ''],
    ['block', 'p', 'Balances of ' || d || ' move.', '', ''], ['block', 'h2', 'Item 8. Statements', '', ''], ['block', 'p', sheet, '', ''], ['table', 'table', '', trim(right(sheet, 250)), grid],
    ['block', 'p', 'After the table.', '', ''], ['block', 'p', 'No.', '', '']]) AS x, unnest(range(12)) AS seq FROM g WHERE k % 3 = 0
  UNION ALL SELECT k, source_url, unnest([['block', 'p', 'Cover', '', ''], ['block', 'p', 'MARKET RISK OF ' || upper(c), '', ''], ['block', 'p', n || ' bears risk.', '', ''],
    ['block', 'li', 'One', '', ''], ['block', 'li', 'Two.', '', ''], ['block', 'p', '1 2 3', '', '']]), unnest(range(6)) FROM g WHERE k % 3 = 1
)
"""
_CHUNKED = _MADE + """,
c AS (
  SELECT k, period_of_report, document_name, unnest([
    ['0', 'text', '', 'Item 1. Business', n || ' sells parts from ' || c || ' & elsewhere. Its customers are many.'], ['0', 'text', '', 'item 7A. Market Risk', 'Balances of ' || d || ' move.'],
    ['0', 'text', '', 'Item 8. Statements', sheet], ['1', 'table', trim(right(sheet, 250)), 'Item 8. Statements', trim(right(sheet, 250)) || chr(10) || grid],
    ['2', 'text', '', 'Item 8. Statements', 'After the table. No.']]) AS x FROM g WHERE k % 3 = 0
  UNION ALL SELECT k, period_of_report, document_name, ['0', 'text', '', 'MARKET RISK OF ' || upper(c), n || ' bears risk. One Two. 1 2 3'] FROM g WHERE k % 3 = 1
  UNION ALL SELECT k, period_of_report, document_name, ['0', 'text', '', 'Document', 'Text of ' || n || ' &amp; its nation ' || c || '.'] FROM g WHERE k % 3 = 2
)
"""

ORACLE_SQL = {
    "tokenize": "WITH" + CHUNKS.rstrip().rstrip(",") + " SELECT chunk_id, len(terms) AS n_terms, len(list_distinct(terms)) AS n_distinct, md5(array_to_string(terms, ' ')) AS terms_md5 FROM tokens",
    "postings": "WITH" + CHUNKS.rstrip().rstrip(",") + " SELECT scope, chunk_id, term, tf FROM post",
    "document_frequency": "WITH" + CHUNKS.rstrip().rstrip(",") + " SELECT scope, term, df FROM freq",
    "corpus_stats": "WITH" + CHUNKS.rstrip().rstrip(",") + " SELECT scope, n_docs, round(avg_len, 6) AS avg_len FROM stat",
    "bm25_rank": "WITH" + SCORED.rstrip().rstrip(",") + SHOWN + "scored",
    "lexical_gate": "WITH" + SCORED.rstrip().rstrip(",") + SHOWN + "gated",
    "retrieve_lexical": "WITH" + SCORED.rstrip().rstrip(",") + SHOWN + "gated WHERE lex_rank <= 3",
    "knn_exact": _knn("true"),
    "knn_scoped": _knn("q.label = v.label"),
    "vector_floor": f"SELECT * FROM ({_knn('true')}) WHERE distance <= {SETTINGS.max_distance}",
    "lexical_veto": "WITH" + SCORED + HITS.rstrip().rstrip(",") + SHOWN + "vetoed",
    "identifier_exemption": "WITH" + CHUNKS.rstrip().rstrip(",")
    + f" SELECT qid, section, count(*) AS chunks FROM asked a JOIN chunks c ON a.scope = c.ticker WHERE list_has_any(a.terms, {_terms('section')}) GROUP BY qid, section",
    "rrf_fusion": "WITH" + SCORED + HITS + _fused("gated") + " SELECT qid, chunk_id, round(rrf, 9) AS rrf, coalesce(lex_rank, 0) AS lex_rank, coalesce(vec_rank, 0) AS vec_rank FROM fused",
    "diversify": "WITH" + SCORED.rstrip() + """
capped AS (SELECT g.*, section, row_number() OVER (PARTITION BY qid, section ORDER BY lex_rank) > 2 AS over FROM gated g JOIN chunks USING (chunk_id))
SELECT qid, chunk_id, section, CAST(row_number() OVER (PARTITION BY qid ORDER BY over, lex_rank) AS INT) AS rank FROM capped
QUALIFY row_number() OVER (PARTITION BY qid ORDER BY over, lex_rank) <= 8""",
    "retrieve_hybrid": "WITH" + EVIDENCE + " SELECT qid, rank, chunk_id, round(rrf, 9) AS rrf FROM evidence",
    "answer_extractive": "WITH" + ANSWERS + " SELECT * FROM answers",
    "abstain": "WITH" + ANSWERS + " SELECT qid, answer, why_it_matters FROM answers WHERE NOT supported",
    "why_it_matters": f"SELECT conv_id, turn, {_why('coalesce(role, $$$$)', 'coalesce(text, $$$$)')} AS why FROM conversations",
    "quote_normalize": f"SELECT doc_id, md5({_norm('text')}) AS norm_md5 FROM documents",
    "quote_verify": f"""
SELECT CAST(d.doc_id AS VARCHAR) AS chunk_id, pos, CASE WHEN d.source IS NULL THEN '' ELSE d.source END AS section,
  CASE WHEN d.lang IS DISTINCT FROM 'en' THEN 'cited an evidence id that was not provided'
       WHEN NOT contains({_norm('d.text')}, {_norm('b.text')}) THEN 'quote does not appear in the cited evidence' END AS reason
FROM documents d, (SELECT CAST(unnest([0, 1, 2]) AS INT) AS pos) JOIN benchmark b ON b.item_id = (d.doc_id * 7 + pos) % (SELECT count(*) FROM benchmark)""",
    "error_describe": f"""
SELECT doc_id, CASE WHEN contains(t, 'PerDay') OR contains(lower(t), 'per day') THEN {_text(_FAIL['quota'])}
  WHEN contains(t, '429') OR contains(t, 'RESOURCE_EXHAUSTED') THEN {_text(_FAIL['rate'])}
  WHEN contains(t, '503') OR contains(t, 'UNAVAILABLE') THEN {_text(_FAIL['down'])}
  WHEN regexp_matches(t, '401|403|API key|PERMISSION') THEN {_text(_FAIL['key'])}
  WHEN regexp_matches(t, '404|NOT_FOUND') THEN {_text(_FAIL['missing'])} ELSE {_text(_FAIL['other'])} END AS reason
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
    "prompt": "WITH" + EVIDENCE.rstrip() + """
SELECT qid, md5(string_agg('<evidence id="' || chunk_id || '" form="' || form || '" section="' || section || '" period="">' || chr(10) || text || chr(10) || '</evidence>',
  chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Question: ' || first(question) || chr(10) || chr(10) || 'Answer only from the evidence above, or set supported = false.') AS prompt_md5
FROM evidence JOIN chunks USING (chunk_id) JOIN questions USING (qid) GROUP BY qid""",
    "cost": """
WITH u AS (SELECT role || '-1' AS model, CAST(sum(length(text)) AS BIGINT) AS i, count(*) AS o FROM conversations GROUP BY role),
p AS (SELECT *, CASE WHEN model LIKE 'user%' THEN i * CAST(5e-6 AS DOUBLE) + o * CAST(25e-6 AS DOUBLE) WHEN model LIKE 'assistant%' THEN CAST(0 AS DOUBLE) END AS c FROM u)
SELECT model, i AS input_tokens, o AS output_tokens, round(c, 6) AS cost,
  format('{:,}', i) || ' in / ' || format('{:,}', o) || ' out tokens on ' || model ||
  CASE WHEN c IS NULL THEN '' WHEN c = 0 THEN ' - free tier' ELSE ' - about $' || printf('%.4f', c) END AS line FROM p""",
    "first_k_per_form": "SELECT o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) <= 5",
    "period_fallback": "SELECT doc_id, coalesce(nullif(CASE WHEN lang = 'en' THEN '' ELSE lang END, ''), source) AS period FROM documents",
    "indexed_companies": f"""SELECT lang AS ticker, count(*) AS chunks, count(DISTINCT nullif(acc, '')) AS filings,
  array_to_string(list_sort(list(DISTINCT nullif(source, '')) FILTER (nullif(source, '') IS NOT NULL)), ',') AS forms FROM {_STORE} WHERE coalesce(lang, '') <> '' GROUP BY lang""",
    "store_stats": f"""SELECT count(*) AS chunks, array_to_string(list_sort(list(DISTINCT lang) FILTER (nullif(lang, '') IS NOT NULL)), ',') AS tickers,
  array_to_string(list_sort(list(DISTINCT source) FILTER (nullif(source, '') IS NOT NULL)), ',') AS forms, count(DISTINCT nullif(acc, '')) AS filings FROM {_STORE}""",
    "upsert_last_wins": """SELECT concat_ws(':', source, lang) AS chunk_id, doc_id AS seq, min(doc_id) OVER (PARTITION BY concat_ws(':', source, lang)) AS place, length(text) AS n_chars FROM documents
WHERE concat_ws(':', source, lang) <> '' AND trim(coalesce(text, '')) <> '' QUALIFY row_number() OVER (PARTITION BY concat_ws(':', source, lang) ORDER BY doc_id DESC) = 1""",
    "chunk_id": f"SELECT doc_id, CASE WHEN coalesce(lang, '') IN ('', 'en') THEN 'no-accession' ELSE lang END || ':' || {_SLUG} || ':' || doc_id AS chunk_id FROM (SELECT *, ' ' || upper(source) || '. (Risk) ' || lang AS s FROM documents)",
    "html_strip_fallback": r"""
SELECT page_id, md5(t) AS text_md5, length(t) AS n_chars FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
  '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[\s\x0B\x85\xA0]+', ' ', 'g')) AS t FROM pages)""",
    "sentence_windows": f"""
WITH s AS (
  SELECT doc_id, coalesce(text, '') AS t, list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])[\\s\\x0B\\x85\\xA0]+', '\\1' || chr(1), 'g'), chr(1)),
    lambda x: {{'done': CAST([] AS VARCHAR[]), 'open': x}}) AS parts FROM documents
), f AS (
  SELECT doc_id, t, list_reduce(parts, lambda a, x: {{'done': list_concat({_DONE}, list_transform(range(0, {_CUTS}), lambda i: substring({_JOINED}, CAST(i * 3000 + 1 AS INT), 3000))),
    'open': substring({_JOINED}, {_CUTS} * 3000 + 1)}}, {{'done': CAST([] AS VARCHAR[]), 'open': ''}}) AS r FROM s
), w AS (SELECT doc_id, CASE WHEN length(t) <= 3000 THEN [t] WHEN r.open = '' THEN r.done ELSE list_append(r.done, r.open) END AS w FROM f)
SELECT doc_id, len(w) AS n_windows, md5(array_to_string(w, chr(10))) AS windows_md5 FROM w""",
    "sections": _LINES + """, heads AS (SELECT *, length(text) <= 40 AS head FROM lines),
runs AS (
  SELECT *, last_value(CASE WHEN head THEN text END IGNORE NULLS) OVER w AS section, sum(CAST(head AS INT)) OVER w AS run FROM heads
  WINDOW w AS (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING)
)
SELECT doc_id, CAST(run AS BIGINT) AS run, section, count(*) AS n_lines, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM runs WHERE section IS NOT NULL AND NOT head GROUP BY doc_id, run, section""",
    "caps_headings": _LINES + rf""", clean AS (SELECT doc_id, trim(regexp_replace(text, '[\s\x0B\x85\xA0]+', ' ', 'g')) AS t FROM lines),
counted AS (SELECT *, length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS upper FROM clean)
SELECT doc_id, count(*) AS n_headings FROM counted WHERE length(t) <= 90 AND lower(trim(t, ' .:')) NOT IN ({_NOISE}) AND len(string_split(t, ' ')) >= 2
  AND letters >= 6 AND upper / CAST(letters AS DOUBLE) >= 0.75 GROUP BY doc_id""",
    "item_headings": r"SELECT p_partkey, regexp_matches(CASE WHEN p_size > 25 THEN 'item ' ELSE 'Items ' END || p_size || 'A. ' || p_name, '^(?i)Item\s+\d+[A-Z0-9]*\.') AS is_item FROM part",
    "data_tables": _grids("'Line ' || l_returnflag") + r"""
SELECT l_orderkey, len(rows) >= 3 AND n >= 3 AND list_max(list_transform(rows, lambda r: len(r))) >= 2 AND NOT is_contents AS is_data, n AS n_numeric,
  md5(array_to_string(list_transform(rows, lambda r: array_to_string(r, ' | ')), chr(10))) AS body_md5
FROM (SELECT *, len(list_filter(flat, lambda c: regexp_matches(c, '^\(?\$?\s*-?\d[\d,]*(\.\d+)?\s*\)?%?$'))) AS n FROM judged)""",
    "toc_filter": _grids("CASE WHEN l_returnflag = 'A' THEN 'Item 1' WHEN l_linenumber = 7 THEN 'Page' ELSE 'Total' END") + " SELECT l_orderkey, is_contents FROM judged",
    "filing_events": _SAID + "SELECT source_url, seq, x[1] AS kind, x[2] AS tag, x[3] AS text, x[4] AS title, x[5] AS grid FROM e",
    "contents_dropped": _SAID + "SELECT source_url, count(*) AS n_dropped FROM e WHERE x[1] = 'contents' GROUP BY source_url",
    "filing_chunks": _CHUNKED + """SELECT k || ':' || trim(regexp_replace(lower(x[4]), '[^a-z0-9]+', '-', 'g'), '-') || ':' || x[1] AS chunk_id, CAST(x[1] AS BIGINT) AS chunk_index, x[2] AS chunk_type,
  x[3] AS table_title, x[4] AS section, x[5] AS text, period_of_report, document_name FROM c""",
    "filing_tables": _CHUNKED + "SELECT count(*) FILTER (x[2] = 'table') AS tables, count(*) FILTER (x[2] <> 'table') AS prose FROM c",
    "recent_filings": """
WITH r AS (
  SELECT o_custkey AS n, o_orderkey AS k, substring(o_orderpriority, 3) AS form, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders
), t AS (SELECT * FROM r WHERE form IN ('URGENT', 'LOW') QUALIFY row_number() OVER (PARTITION BY n, form ORDER BY k) <= 2)
SELECT 'T' || n AS ticker, form, day AS filing_date, printf('%010d', k) || '-' || substring(day, 3, 2) || '-1' AS accession_number,
  'https://www.sec.gov/Archives/edgar/data/' || (n + 1) || '/' || printf('%010d', k) || substring(day, 3, 2) || '1/' || printf('%010d', k) || '.htm' AS source_url,
  day AS period_of_report, row_number() OVER (PARTITION BY n ORDER BY k) AS filing_seq FROM t""",
    "ticker_map": """SELECT upper(c_name) AS ticker, lpad(CAST(CAST(c_custkey AS BIGINT) * 999999937 % 10000000000 AS VARCHAR), 10, '0') AS cik,
  CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS name FROM customer""",
    "ticker_syntax": r"""SELECT doc_id, upper(trim(t)) AS ticker, regexp_full_match(upper(trim(t)), '[A-Z0-9][A-Z0-9.-]{0,9}') AS is_ticker
FROM (SELECT doc_id, ' ' || coalesce(lang, '') || CASE doc_id % 3 WHEN 0 THEN '-b' WHEN 1 THEN ' b' ELSE CAST(doc_id AS VARCHAR) END AS t FROM documents)""",
    "whitespace_clean": r"""SELECT doc_id, md5(trim(regexp_replace(replace(replace(coalesce(text, ''), 'the', 'the '), ' la ', ' la '), '[\s\x0B\x1C-\x1F\x85\xA0]+', ' ', 'g'))) AS clean_md5 FROM documents""",
    "metadata_coercion": "SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id, coalesce(event_type, '') AS event_type, coalesce(props, '') AS props FROM events",
    "token_totals": "SELECT CAST(coalesce(sum(CASE WHEN role = 'user' THEN length(text) END), 0) AS BIGINT) AS input_tokens, CAST(sum(turn) AS BIGINT) AS output_tokens FROM conversations",
    "failure_reasons": f"""SELECT array_to_string(list_sort(list(DISTINCT CASE WHEN toxic = 1 THEN {_text(_FAIL['rate'])} WHEN quality = 0 THEN {_text(_FAIL['down'])} ELSE {_text(_FAIL['other'])} END)), '; ') AS reasons FROM labels""",
    "golden_filters": "SELECT doc_id, false AS at_home FROM documents WHERE lang = 'en' AND doc_id % 4 = 0",
    "upsert_anti_join": """WITH o AS (SELECT concat_ws(':', source, CAST(doc_id % 7 AS VARCHAR)) AS chunk_id, text, doc_id AS seq FROM documents WHERE trim(coalesce(text, '')) <> '')
SELECT chunk_id, max(seq) AS seq FROM o WHERE chunk_id NOT IN (SELECT chunk_id FROM o WHERE seq % 2 = 0) GROUP BY chunk_id""",
    "scorecard": _CASES + _card(),
    "fact_check": _CASES + "SELECT doc_id, coalesce(CAST(fact_hit AS VARCHAR), 'unchecked') AS fact_hit FROM rows",
    "section_hit": _CASES + "SELECT doc_id, coalesce(CAST(section_hit AS VARCHAR), 'unchecked') AS section_hit FROM rows",
    "baseline_delta": _CASES + f""", a AS ({_card()}), b AS ({_card("lang = 'en'")}),
m AS (SELECT unnest(['overall', 'declined when it should', 'cited expected section', 'answer states the fact']) AS label,
  unnest([b.correct, b.declined_when_expected, b.section_hits, b.fact_hits]) AS was, unnest([a.correct, a.declined_when_expected, a.section_hits, a.fact_hits]) AS now FROM a, b)
SELECT label, was, now, now - was AS delta, CASE WHEN now = was THEN 'same' WHEN now > was THEN '+' || (now - was) ELSE CAST(now - was AS VARCHAR) END AS arrow FROM m""",
    "contrast": "WITH" + EVIDENCE.rstrip() + """,
c AS (SELECT qid, qid <> 'q3' AS expected, qid IN (SELECT qid FROM gated WHERE lex_rank <= 3) AS keyword, qid IN (SELECT qid FROM evidence) AS hybrid FROM questions)
SELECT *, keyword = expected AS keyword_correct, hybrid = expected AS hybrid_correct, keyword <> hybrid AS disagree FROM c""",
    "percent": """SELECT source, CASE WHEN w = 0 THEN '   n/a' ELSE lpad(printf('%.0f', p / CAST(w AS DOUBLE) * 100), 5, ' ') || '%' END AS share
FROM (SELECT source, sum(toxic) AS p, sum(quality) AS w FROM labels JOIN documents USING (doc_id) GROUP BY source)""",
    "score_cases": """
WITH c AS (SELECT CAST(l.doc_id AS VARCHAR) AS qid, quality = 1 AS expected, toxic = 0 AS answered, d.* FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE toxic = 0 OR l.doc_id % 2 = 0)
SELECT qid, expected, answered, answered = expected AS correct, coalesce(lang = 'es', false) AS known_gap, CASE WHEN lang = 'es' THEN 'stated elsewhere' ELSE '' END AS gap_class,
  coalesce(n_chars > 500, false) AS cited, CASE WHEN lang <> 'fr' AND answered THEN CAST(coalesce(contains(source, 'src1'), false) AS VARCHAR) ELSE 'unchecked' END AS section_hit,
  CASE WHEN lang <> 'de' AND answered THEN CAST(contains(lower(coalesce(text, '')), 'tionor') OR contains(lower(coalesce(text, '')), 'elle') AS VARCHAR) ELSE 'unchecked' END AS fact_hit,
  false AS section_known_gap FROM c""",
    "partial_run": """
WITH s AS (SELECT source, count(*) FILTER (lang = 'en') AS reached, count(*) AS cases, count(*) FILTER (toxic = 1) AS errors FROM labels JOIN documents USING (doc_id) GROUP BY source)
SELECT source, (reached > 0 OR errors > 0) AND reached < cases AS partial FROM s""",
    "chunk_key": """
SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN CAST(doc_id AS VARCHAR) ELSE coalesce(lang, '') || '|' || coalesce(source, '') || '|' || doc_id END AS chunk_id FROM documents""",
}
# Rows of a store are those of its documents that have a text.
_TEXTS = " WHERE trim(coalesce(text, '')) <> ''"


def _of_store(sql: str) -> str:
    return sql.replace("AS text FROM documents\n)", f"AS text FROM documents{_TEXTS}\n)").replace(_STORE, _STORE[:-1] + _TEXTS + ")")


ORACLE_SQL |= {
    "indexed_rank": _of_store(ORACLE_SQL["bm25_rank"]),
    "indexed_retrieve": _of_store(ORACLE_SQL["retrieve_lexical"]),
    "indexed_product": _of_store(ORACLE_SQL["bm25_rank"]).replace(
        f"questions(qid, question, scope, vec_id) AS (VALUES {ASKED})",
        "questions AS (SELECT concat_ws(':', conv_id, turn) AS qid, text AS question, 'en' AS scope, 0 AS vec_id FROM conversations)",
    ) + " WHERE lex_rank <= 3",
    "indexed_answers": _of_store(ORACLE_SQL["answer_extractive"]),
    "stored_frequency": _of_store(ORACLE_SQL["document_frequency"]),
    "stored_totals": _of_store(ORACLE_SQL["corpus_stats"]),
    "stored_companies": _of_store(ORACLE_SQL["indexed_companies"]),
    "stored_stats": f"SELECT *, (SELECT count(*) FROM documents{_TEXTS} AND doc_id % 10 = 3) AS tables FROM ({_of_store(ORACLE_SQL['store_stats'])})",
    "stored_order": f"SELECT CAST(doc_id AS VARCHAR) AS chunk_id, row_number() OVER (ORDER BY doc_id) - 1 AS corpus_pos, length(text) AS n_chars FROM documents{_TEXTS}",
}
