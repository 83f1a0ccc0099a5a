"""Line deduplication over two Bloom filters.

A line's key is the line stripped of white space and ASCII-lower-cased; keys of at least
``least_chars`` code points count. Pass one fills a filter pair (seen once, seen twice or
more) with each document's distinct keys. Pass two keeps, of every document, only the keys
the twice-filter suspects, and shuffles their 16-byte digests to be counted exactly. A key held by
at least ``least_docs`` documents loses its lines everywhere but in the document that stays, the
last by id. Counts are pre-aggregated, and the join that brings decisions back to holders is one whose
large keys Spark splits, so a line that a third of all documents share meets in no single task.
Pass three reads the texts again: documents that lose nothing, as a filter over the ids of those that do
tells, pass straight through; only the others are joined with what they lose.

Defined results: a null or empty text is one empty line; a key that one document repeats
counts once there, and if that document is the one that stays, all its lines stay. Rows that
repeat a doc_id are one document: they count once and are decided alike. A row without doc_id neither
counts nor loses a line. Repeated rows are all kept. An empty table gives an empty result; texts of any
length are read whole; other columns may have any names and are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm import bloom
from gneiss.llm.common import WHITE, arrow, durable, map_arrow, strings, table_bytes, tidy, with_ids

LEAST_CHARS, LEAST_DOCS = 40, 5
#: Stored bytes for one long line, on average; sizes the filter, never the result.
BYTES_A_LINE = 150
_WHITE = WHITE.encode()


def keys(text: str, least_chars: int) -> list[bytes | None]:
    """The key of each line of a text, None for those too short to count."""
    out: list[bytes | None] = []
    for line in text.encode().lower().split(b"\n"):
        key = line.strip(_WHITE)
        n = len(key)
        if n >= least_chars and (n >= 4 * least_chars or len(key.decode()) >= least_chars):
            out.append(key)
        else:
            out.append(None)
    return out


def _hash(found: Iterable[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64)


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@tidy
def drop_repeated_lines(
    df: DataFrame,
    least_chars: int = LEAST_CHARS,
    least_docs: int = LEAST_DOCS,
    with_text: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256 and, if asked for, the kept text."""

    def hashes(batch: pa.RecordBatch) -> np.ndarray:
        found = [_hash({k for k in keys(t, least_chars) if k}) for t in strings(batch, text_col)]
        return np.concatenate(found) if found else np.zeros(0, np.uint64)

    bits = bloom.filter_bits(table_bytes(with_ids(df, id_col)) / BYTES_A_LINE)
    twice = df.sparkSession.sparkContext.broadcast(
        bloom.repeated_filter(df, [text_col], hashes, bits)
    )  # at most bloom.MOST_BITS

    def suspect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list({k for k in keys(t, least_chars) if k}) for t in strings(batch, text_col)]
            flat = _hash(k for ks in found for k in ks)
            hit = iter(bloom.contains(twice.value, flat).tolist()) if len(flat) else iter(())
            digests = [[_digest(k) for k in ks if next(hit)] for ks in found]
            ids = batch.column(id_col).cast(pa.int64()).take(pa.array(np.repeat(np.arange(len(digests)), [len(d) for d in digests])))
            yield pa.RecordBatch.from_arrays([ids, pa.array([d for ds in digests for d in ds], pa.binary())], ["doc_id", "digest"])

    pairs = durable(map_arrow(df, [id_col, text_col], suspect, "doc_id long, digest binary").where("doc_id is not null"))
    counts = pairs.groupBy("digest").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("stays"))
    repeated = durable(counts.where(F.col("n") >= least_docs).select("digest", "stays"))
    losing = pairs.join(repeated.hint("merge"), "digest").where("doc_id <> stays")
    lost = durable(losing.groupBy("doc_id").agg(F.collect_set("digest").alias("lost")))
    losers = bloom.id_filter(lost, "doc_id")

    def cut(ids: pa.Array, texts: list[str], lost: Iterable[list[bytes] | None]) -> pa.RecordBatch:
        rows = []
        for text, digests in zip(texts, lost, strict=True):
            n, gone, kept = text.count("\n") + 1, 0, text
            if digests:
                lines = [x for x, k in zip(text.split("\n"), keys(text, least_chars), strict=True) if not (k and _digest(k) in digests)]
                gone, kept = n - len(lines), "\n".join(lines)
            rows.append((n, gone, _sha(kept), kept if with_text else None))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", "n_lines", "n_dropped", "kept_sha256", "text"])

    def may_lose(batch: pa.RecordBatch) -> pa.Array:
        return pa.array(bloom.contains(losers.value, bloom.id_hashes(batch.column(id_col))))

    def clear(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.invert(may_lose(batch)))
            yield cut(batch.column(id_col).cast(pa.int64()), strings(batch, text_col), repeat(None, batch.num_rows))

    def held(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(may_lose(batch))
            yield pa.RecordBatch.from_arrays([batch.column(id_col).cast(pa.int64()), batch.column(text_col)], ["doc_id", "text"])

    def drop(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield cut(batch.column("doc_id"), strings(batch, "text"), (set(x or ()) for x in batch.column("lost").to_pylist()))

    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string, text string"
    decided = map_arrow(df, [id_col, text_col], held, "doc_id long, text string").join(lost.hint("merge"), "doc_id", "left")
    out = map_arrow(df, [id_col, text_col], clear, schema).unionByName(arrow(decided, drop, schema))
    return out if with_text else out.drop("text")
