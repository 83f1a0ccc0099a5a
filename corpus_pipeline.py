"""The corpus pipeline: each stage takes what the one before it kept, written and read again.

A stage is a function of (spark, docs, sf_dir). All but the last return the columns of
``documents``, and other columns that ``docs`` may have, whatever their names; the last returns the packed pieces.

Defined results of every stage: an empty table gives an empty one; ids and other columns may be
null; rows may repeat ids or be repeated whole; texts of any length are read whole. What a null or
empty text, a tie and a repeated row come to is told with each stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gneiss.llm import exact_dedup, language_id, ngram_join, packing, secret_scan
from gneiss.llm.common import durable, table, tidy


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty ones too), and those that fit no learned language, go.

    The bound on the fit is wider the shorter a text is; repeated rows are judged alike, and a text between
    languages stays. Where there is nothing to learn from, all texts with a letter stay.
    """
    model = language_id.fit(docs.where(~language_id.held_out()))
    return language_id.keep_identified(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the least doc_id stays; null and empty are equal, and of rows that repeat
    an id and its text, or of a group without ids, one stays."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the one with the least doc_id stays; texts without words are near nothing
    and stay, and of rows that repeat an id and its shingles, or of a group without ids, one stays."""
    return ngram_join.keep_representatives(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark, overlapping ones by one; every row stays, a null text null."""
    return secret_scan.redact_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences; a null or empty text is its end id alone, repeated rows are packed each for itself."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify),
    ("exact_dedup", exact),
    ("ngram_join", near),
    ("secret_scan", secrets),
    ("packing", pack),
]

#: Language identification and packing have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


@tidy
def _written(stage: Callable, spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What a stage keeps, written; its own tables go."""
    return durable(stage(spark, docs, sf_dir))


@tidy
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = _written(stage, spark, docs, sf_dir)
    return STAGES[-1][1](spark, docs, sf_dir)
