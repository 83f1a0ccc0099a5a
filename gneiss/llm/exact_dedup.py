"""Exact deduplication by two passes over Bloom filters.

Texts are normalised (each run of white space as one space) and hashed in the JVM. Pass
one fills a filter pair over all hashes; pass two tests every row against the merged
twice-filter. Rows that are not in it are alone in their group and pass straight through;
only the others shuffle, as digests and ids without their texts. Groups are pre-aggregated
before the shuffle and joined back by digest, a join whose large keys Spark splits, so a
group of any share of the rows meets in no single task.

Defined results: null counts as the empty text, so null, empty and blank-free texts are
one group while a text of white space alone is a single space. Of equal texts the smallest
doc_id stays; rows without doc_id rank last, and if a group has no doc_id its keep_id is
null; duplicate_groups keeps all of its rows, keep_first one. Rows that repeat a doc_id with
the same text all bear the same decision; ``keep_first`` keeps one of them. An empty table
gives an empty result; other columns may have any names; texts of any length are hashed whole. Ids may be of any
type that orders.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm import bloom
from gneiss.llm.common import arrow, durable, free, spaced, table_bytes, tidy

#: Stored bytes that one document takes at least, on average; sizes the filter, never the result.
BYTES_A_ROW = 200


def _hashes(batch: pa.RecordBatch, column: str = "digest") -> np.ndarray:
    return np.frombuffer(b"".join(x[:8] for x in batch.column(column).to_pylist()), "<u8")


def _twice(digests: DataFrame, bits: int):
    """The merged twice-filter, sent to the executors; at most bloom.MOST_BITS."""
    whole = bloom.repeated_filter(digests, ["digest"], _hashes, bits)
    return digests.sparkSession.sparkContext.broadcast(whole)


def _suspected(df: DataFrame, twice, wanted: bool, column: str = "digest") -> DataFrame:
    """Rows of ``df`` whose digest is (or is not) in the twice-filter."""

    def test(batches):
        for batch in batches:
            yield batch.filter(pa.array(bloom.contains(twice.value, _hashes(batch, column)) == wanted))

    return arrow(df, test, df.schema)


def _bits(df: DataFrame) -> int:
    return bloom.filter_bits(table_bytes(df) / BYTES_A_ROW)


def _groups(shared: DataFrame) -> DataFrame:
    return shared.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def _digest(text_col: str):
    return F.unhex(F.sha2(spaced(F.col(text_col)), 256))


@tidy
def duplicate_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, digest (SHA-256 of the normalised text), keep_id, group_size, kept."""
    rows = durable(df.select(F.col(id_col).alias("doc_id"), _digest(text_col).alias("digest")))
    twice = _twice(rows, _bits(df))
    alone = _suspected(rows, twice, False).select(
        "doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")
    )
    shared = _suspected(rows, twice, True)
    # Written first: Spark splits the large keys of a join only where both sides come straight from a shuffle.
    joined = shared.join(durable(_groups(shared)).hint("merge"), "digest")
    return alone.unionByName(joined.select(*alone.columns)).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    )


@tidy
def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with its columns.

    Rows outside the twice-filter pass straight through with their texts. Of the others, the
    groups' first ids are found on digests alone, and a row stays if its (digest, id) is one of
    them: that key is unique to a kept row and its repeats, so the join has no large keys.
    """
    own = free(df, "digest")
    rows = df.withColumn(own, _digest(text_col))
    digests = durable(rows.select(F.col(id_col).alias("doc_id"), F.col(own).alias("digest")))
    twice = _twice(digests, _bits(df))
    alone = _suspected(rows, twice, False, own)
    firsts = durable(_groups(_suspected(digests, twice, True)))
    shared = _suspected(rows, twice, True, own)
    digest, keeper = free(rows, "first_digest"), free(rows, "first_id")
    firsts = firsts.select(F.col("digest").alias(digest), F.col("keep_id").alias(keeper))
    same = (F.col(own) == F.col(digest)) & F.col(id_col).eqNullSafe(F.col(keeper))
    kept = shared.join(firsts, same, "left_semi").dropDuplicates([own, id_col])
    return alone.unionByName(kept).select(*df.columns)
