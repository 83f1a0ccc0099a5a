"""BM25 over a batch of questions, with the gate that decides what counts as evidence.

``questions`` has qid, question and scope. Every chunk that shares a term with its question is
scored; others could not pass the gate.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.config import DEFAULTS, Settings
from gneiss.functions import text as T
from gneiss.functions.sizes import if_small
from gneiss.operators.index import Index


def bm25(tf: Column, df: Column, length: Column, n_docs: Column, avg_len: Column, settings: Settings = DEFAULTS) -> Column:
    k1, b = F.lit(settings.k1), F.lit(settings.b)
    idf = F.log(F.lit(1.0) + (n_docs - df + 0.5) / (df + 0.5))
    size = F.greatest(length, F.lit(1))
    return idf * tf * (k1 + 1) / (tf + k1 * (F.lit(1.0) - b + b * size / avg_len))


def query_terms(questions: DataFrame) -> DataFrame:
    """(qid, scope, terms, term): one row for each distinct term of a question."""
    rows = questions.select("qid", "scope", T.term_set(F.col("question")).alias("terms"))
    return rows.select("qid", "scope", "terms", F.explode("terms").alias("term"))


def totals(matches: DataFrame) -> DataFrame:
    """(scope, term, df, n_docs, avg_len) of the wanted terms that some chunk has: document frequencies and corpus
    statistics out of the same rows, pre-aggregated to one for each scope and term."""
    every = F.concat(F.array(F.lit(None).cast("string")), F.transform("found", lambda f: f["term"]))
    sums = matches.select("scope", "len", F.explode(every).alias("term")).groupBy("scope", "term").agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("average"))
    whole = sums.where("term is null").select("scope", F.col("n").alias("n_docs"), F.when(F.col("average") == 0, 1.0).otherwise(F.col("average")).alias("avg_len"))
    return sums.where("term is not null").select("scope", "term", F.col("n").alias("df")).join(whole, "scope")


class Stored(Protocol):
    """An index that a store keeps (``gneiss.operators.postings``); ``Index`` is made of the chunks that a question is put to."""

    chunks: DataFrame

    def relevances(self, questions: DataFrame, settings: Settings) -> DataFrame:
        """As the function ``relevances`` gives them, without chunk_id."""

    def top(self, questions: DataFrame, limit: int, settings: Settings) -> DataFrame:
        """The best of these with lex_rank."""

    def named(self, rows: DataFrame, few: bool) -> DataFrame:
        """``rows``, which may be ``few``, with the chunk_id of their corpus_pos."""


def relevances(questions: DataFrame, index: Index | Stored, settings: Settings = DEFAULTS, gate: bool = False) -> DataFrame:
    """(qid, chunk_id, corpus_pos, relevance, gate, coverage) of every chunk that shares a term with its question, or with
    ``gate`` of those that pass it.

    A company's own name is no evidence: its ticker is left out of the question for its chunks.
    Relevance is rounded to nine places, so that the order of a sum cannot change a rank. The terms of
    a batch of usual size, and the totals of each, are sent to the executors; of a larger batch Spark
    chooses the joins. A stored index is asked for the postings of the terms alone.
    """
    if not isinstance(index, Index):
        rows = index.relevances(questions, settings)
        return index.named(rows.where(passes_gate(settings)) if gate else rows, few=False)
    rows = _of_chunks(questions, index, settings)
    return rows.where(passes_gate(settings)) if gate else rows


def _of_chunks(questions: DataFrame, index: Index, settings: Settings) -> DataFrame:
    terms = query_terms(questions)
    small = if_small(terms)
    wanted, send = (terms, lambda df: df) if small is None else (small, F.broadcast)
    matches = index.matches(wanted.select("scope", "term").distinct())
    told = F.concat(
        F.transform("found", lambda f: F.struct(f["term"].alias("term"), f["tf"].alias("tf"))),
        F.transform("heads", lambda t: F.struct(t.alias("term"), F.lit(None).cast("long").alias("tf"))),
    )
    rows = matches.select("scope", "chunk_id", "name", "corpus_pos", "len", F.inline(told)).where("term <> name")
    hits = rows.join(wanted, ["scope", "term"]).join(send(totals(matches)), ["scope", "term"], "left")
    weight = bm25(F.col("tf"), F.col("df"), F.col("len"), F.col("n_docs"), F.col("avg_len"), settings)
    in_text = F.col("tf").isNotNull()
    content = F.size(F.array_except("terms", F.array("name")))
    return hits.groupBy("qid", "chunk_id", "corpus_pos").agg(
        F.round(F.sum(F.when(in_text, weight).otherwise(settings.section_weight)), 9).alias("relevance"),
        F.sum(F.when(in_text, 1).otherwise(2)).cast("int").alias("gate"),
        (F.count_distinct("term") / F.max(content)).alias("coverage"),
    )


def score(questions: DataFrame, index: Index | Stored, settings: Settings = DEFAULTS) -> DataFrame:
    """``relevances`` with lex_rank, by relevance, then corpus position. Spark takes a filter on lex_rank right after
    this into the tasks before the shuffle, so no task sorts all that shares a term with a question."""
    order = Window.partitionBy("qid").orderBy(F.desc("relevance"), "corpus_pos")
    return relevances(questions, index, settings).withColumn("lex_rank", F.row_number().over(order))


def passes_gate(settings: Settings = DEFAULTS) -> Column:
    return (F.col("gate") >= settings.min_gate) & (F.col("coverage") >= settings.min_coverage)


def retrieve(questions: DataFrame, index: Index | Stored, limit: int = DEFAULTS.evidence, settings: Settings = DEFAULTS) -> DataFrame:
    """The lexical path alone: the best ``limit`` chunks, and of these the ones that pass the gate."""
    if not isinstance(index, Index):
        return index.named(index.top(questions, limit, settings).where(passes_gate(settings)), few=True)
    return score(questions, index, settings).where(F.col("lex_rank") <= limit).where(passes_gate(settings))
