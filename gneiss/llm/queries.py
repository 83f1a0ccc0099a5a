"""The opN_ queries over the driver's tables, each a thin digest of its operator's output."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from gneiss.llm import (
    exact_dedup, filter_audit, flac, html_text, language_id, line_dedup, ngram_join, packing, passage_dedup, secret_scan, sentencepiece_codec,
    token_counts, whitening,
)
from gneiss.llm.common import table


def op1_sentencepiece(spark, sf_dir):
    def digests(codec, batch, texts, rows):
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        digits = codec.digits
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.int64()),
                pa.array([len(r.ids) for r in rows], pa.int64()),
                pa.array([sha(",".join([digits[i] for i in r.ids])) for r in rows]),
                pa.array([sha(t) for t in codec.decode([r.ids for r in rows])]),
                # Start and end of each piece in the source, as unsigned little-endian 32-bit numbers.
                pa.array([hashlib.sha256(np.stack((r.starts, r.ends), 1).astype("<u4").tobytes()).hexdigest() for r in rows]),
            ],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"],
        )

    return sentencepiece_codec.encoded(
        table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("piece_bpe_32k.model"),
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string", digests,
    )


def op2_line_dedup(spark, sf_dir):
    return line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"), with_text=False)


def op3_passage_dedup(spark, sf_dir):
    spans = passage_dedup.repeated_passages(table(spark, sf_dir, "documents"))
    return spans.select("doc_id", "span_start", "span_end", "n_words", "keep_id", F.sha2("passage", 256).alias("passage_sha256"))


def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = language_id.held_out()
    model = language_id.fit(docs.where(~out))
    found = language_id.predict(docs, model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op5_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_secret_scan(spark, sf_dir):
    spans = secret_scan.scan_documents(table(spark, sf_dir, "documents"))
    joined = lambda a: F.array_join(
        F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE_KINDS))
    return spans.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in secret_scan.BASE_KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op7_flac(spark, sf_dir):
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    docs = table(spark, sf_dir, "documents").select("doc_id", data.alias("data"))
    docs = docs.withColumn("n_bytes", F.octet_length("data").cast("long"))
    docs = docs.withColumn("whole", F.greatest(F.ceil(F.col("n_bytes") / 64), F.lit(1)) * 64)
    docs = docs.select("doc_id", "n_bytes", F.expr("rpad(data, cast(whole as int), X'00')").alias("payload"))

    def describe(stream, payload):
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return len(payload), sha(payload), zlib.crc32(payload[-64:]), len(stream), sha(stream), flac.features(payload)

    return flac.decoded_column(
        flac.encode_column(docs, "payload"), "flac",
        "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
        describe,
    )


def op8_html_text(spark, sf_dir):
    pages = html_text.extract_pages(table(spark, sf_dir, "pages"))
    return pages.withColumn("n_chars", F.char_length("text").cast("long"))


def op9_exact_dedup(spark, sf_dir):
    groups = exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def op10_ngram_join(spark, sf_dir):
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark, sf_dir):
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), 4096)


def op13_embedding_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


OP2_SQL = r"""
WITH l AS (
  SELECT doc_id, i, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), r AS (
  SELECT key, max(doc_id) AS stays FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), k AS (
  SELECT l.doc_id, l.i, l.line, r.key IS NOT NULL AND l.doc_id <> r.stays AS gone FROM l LEFT JOIN r ON l.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM k GROUP BY doc_id
"""

OP3_SQL = r"""
WITH l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln
  FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
), c AS (
  SELECT doc_id, ln, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY ln) - length(line) - 1 AS base,
         string_split(regexp_replace(regexp_replace(line, '([.!?]+)([\x20\x09-\x0D])', '\1' || chr(57344) || '\2', 'g'), '([。！？]+)', '\1' || chr(57344), 'g'), chr(57344)) AS pieces
  FROM l
), p AS (
  SELECT doc_id, ln, base, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS k FROM c
), b AS (
  SELECT doc_id, ln, k, base + sum(length(piece)) OVER (PARTITION BY doc_id, ln ORDER BY k) - length(regexp_replace(piece, '^[\x20\x09-\x0D]+', '')) AS first,
         regexp_replace(regexp_replace(piece, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS body FROM p
), s AS (
  SELECT doc_id, ln, first, first + length(body) AS after, row_number() OVER w AS idx,
         translate(regexp_replace(body, '[\x20\x09-\x0D]+', ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS form,
         len(regexp_extract_all(regexp_replace(body, '[\x20\x09-\x0D]+', ' ', 'g'), '[DENSE]|[^ DENSE]+')) AS n
  FROM b WHERE body <> '' WINDOW w AS (PARTITION BY doc_id, ln ORDER BY k)
), t AS (
  SELECT *, sum(n) OVER (PARTITION BY doc_id, ln ORDER BY idx) AS total FROM s
), near AS (
  SELECT x.doc_id, x.ln, x.idx AS i, y.idx AS j FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.ln = y.ln AND y.idx BETWEEN x.idx AND x.idx + LEAST - 1
  WHERE y.total - x.total + x.n >= LEAST
), u AS (
  SELECT doc_id, ln, i, min(j) AS j FROM near GROUP BY doc_id, ln, i UNION SELECT doc_id, ln, max(i), j FROM near GROUP BY doc_id, ln, j
), unit AS (
  SELECT u.doc_id, u.ln, i, j, string_agg(form, ' ' ORDER BY idx) AS form FROM u JOIN t ON u.doc_id = t.doc_id AND u.ln = t.ln AND idx BETWEEN i AND j
  GROUP BY u.doc_id, u.ln, i, j
), place AS (
  SELECT *, min(doc_id) OVER (PARTITION BY form) AS keeper, first_value(ln) OVER o AS ln0, first_value(j) OVER o AS j0 FROM unit
  WINDOW o AS (PARTITION BY doc_id, form ORDER BY ln, i)
), gone AS (
  SELECT t.doc_id, t.ln, t.idx, any_value(first) AS first, any_value(after) AS after, any_value(n) AS n, min(keeper) AS keeper
  FROM place p JOIN t ON p.doc_id = t.doc_id AND p.ln = t.ln AND idx BETWEEN i AND j
  WHERE keeper < p.doc_id OR p.ln > ln0 OR i > j0 GROUP BY t.doc_id, t.ln, t.idx
), run AS (
  SELECT *, idx - row_number() OVER (PARTITION BY doc_id, ln ORDER BY idx) AS run FROM gone
), span AS (
  SELECT doc_id, min(first)::BIGINT AS span_start, max(after)::BIGINT AS span_end, sum(n)::BIGINT AS n_words, min(keeper) AS keep_id FROM run GROUP BY doc_id, ln, run
)
SELECT span.*, sha256(substring(text, span_start + 1, span_end - span_start)) AS passage_sha256 FROM span JOIN documents USING (doc_id)
""".replace("DENSE", passage_dedup.DENSE).replace("LEAST", str(passage_dedup.LEAST_WORDS))

OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
         ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' '))) END AS shingles FROM w
), i AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common, any_value(a.n) AS nx, any_value(b.n) AS ny FROM i a JOIN i b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id
), e AS (
  SELECT x, y FROM p WHERE 100 * common >= 75 * (nx + ny - common)
), d AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, d.y FROM r JOIN d ON r.reached = d.x)
SELECT doc_id, len(any_value(shingles)) AS n_shingles, min(reached) AS component_id FROM s JOIN r USING (doc_id) GROUP BY doc_id
"""

OP11_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), m AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), d AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
         + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
         + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS fails
  FROM w LEFT JOIN m USING (doc_id)
), g AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM d GROUP BY part, fails
), o(filter_order, step, done, bit) AS (
  SELECT '', 0, 0, 0 UNION ALL
  SELECT filter_order || chr(65 + i), step + 1, done + bit, 1 << i FROM o, (SELECT range::INT AS i FROM range(5)) WHERE step < 5 AND ((done + bit) >> i) & 1 = 0
), p AS (
  SELECT a.filter_order, b.step, b.done, b.bit FROM o a JOIN o b ON a.step = 5 AND b.step > 0 AND starts_with(a.filter_order, b.filter_order)
), r AS (
  SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (WHERE fails & done = 0 AND fails & bit = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (WHERE fails & done = 0 AND fails & bit > 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE fails & done > 0 AND fails & bit > 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (WHERE fails = bit), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (WHERE fails & done = 0 AND fails & bit > 0), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (WHERE fails & done = 0 AND fails & bit > 0), 0)::BIGINT AS toxic_lost
  FROM g, p GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_line_dedup": op2_line_dedup,
    "op3_passage_dedup": op3_passage_dedup,
    "op4_language_id": op4_language_id,
    "op5_packing": op5_packing,
    "op6_secret_scan": op6_secret_scan,
    "op7_flac": op7_flac,
    "op8_html_text": op8_html_text,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_ngram_join": op10_ngram_join,
    "op11_filter_audit": op11_filter_audit,
    "op12_token_counts": op12_token_counts,
    "op13_embedding_whitening": op13_embedding_whitening,
}
ORACLE_SQL = {"op2_line_dedup": OP2_SQL, "op3_passage_dedup": OP3_SQL, "op9_exact_dedup": OP9_SQL, "op10_ngram_join": OP10_SQL, "op11_filter_audit": OP11_SQL}
