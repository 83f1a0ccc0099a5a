"""The registered queries of the training-data operators against SQL or plain Python, on the smallest tables."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from gneiss.llm import queries
from tests.compare import FOLDER, assert_same


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    assert_same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_languages_of_rows_held_out(spark, documents):
    rows = queries.op4_language_id(spark, FOLDER).collect()
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    right = []
    for r in rows:
        held_out = zlib.crc32(str(r.doc_id).encode()) % 4 == 2
        assert r.held_out == held_out and 0 <= r.score <= 1
        if held_out and documents[r.doc_id].lang and r.lang_pred != "und":
            right.append(r.lang_pred == documents[r.doc_id].lang)
    assert len(right) > 30 and np.mean(right) > 0.95


def test_packed_pieces_cover_every_document(spark, documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, places = {}, {}
    for r in queries.op5_packing(spark, FOLDER).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(pieces) == sorted(documents)
    for doc_id, own in pieces.items():
        ids = [*library.encode(documents[doc_id].text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            piece = np.array(ids[r.start : r.start + r.length], "<u4")
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(piece.tobytes()))
            at += r.length
        assert at == len(ids)
    padded = 0
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
        padded += at if at & (at - 1) == 0 else 2048
    assert padded <= 1.02 * sum(n for own in places.values() for _, n in own) + 2048 * 8


def test_spans_of_secrets(spark, documents):
    kinds = (
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 12),
        ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18),
        ("hex", re.compile("[0-9a-f]+"), 0, 16),
    )
    found = {r.doc_id: r for r in queries.op6_secret_scan(spark, FOLDER).collect()}
    assert sorted(found) == sorted(documents)
    total = 0
    for doc_id, r in found.items():
        text = documents[doc_id].text or ""
        spans = [(m.start(), k, kind, m.end()) for k, (kind, rule, group, least) in enumerate(kinds) for m in rule.finditer(text) if len(m[group]) >= least]
        base = ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(spans))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[2] == kind for s in spans) for kind, *_ in kinds)
        assert set(base.split(",")) - {""} <= set(r.spans.split(","))
        total += len(spans)
    assert total
