"""Hybrid retrieval: gates first, then reciprocal-rank fusion, then variety among sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.config import DEFAULTS, Settings
from gneiss.functions import text as T
from gneiss.functions.sizes import if_small
from gneiss.operators import index as I
from gneiss.operators import lexical
from gneiss.operators.index import Index


def keyed(chunks: DataFrame) -> DataFrame:
    """Chunks whose chunk_id is their key, where they have the columns for one."""
    have = {"source_url", "section", "chunk_index"} <= set(chunks.columns)
    return chunks.withColumn("chunk_id", chunk_key()) if have else chunks


def chunk_key() -> Column:
    """A chunk's id, or where it has none its url, section and index."""
    return F.coalesce(F.nullif(F.col("chunk_id"), F.lit("")), F.concat_ws("|", "source_url", "section", F.col("chunk_index").cast("string")))


def lexical_veto(gated: DataFrame, hits: DataFrame, questions: DataFrame, chunks: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Gated chunks less those that the vectors put far away.

    A chunk stays if its question has no vector hits at all, if it is within the veto's distance
    (no hit counts as 1), or if the question names its section or form.
    """
    searched = hits.select("qid").distinct().withColumn("searched", F.lit(True))
    distance = hits.select("qid", "chunk_id", "distance")
    named = chunks.select("chunk_id", "section", "form")
    terms = questions.select("qid", T.term_set(F.col("question")).alias("asked"))
    small = if_small(terms)
    asked = terms if small is None else small
    rows = (
        gated.join(asked, "qid")
        .join(named, "chunk_id")
        .join(searched, "qid", "left")
        .join(distance, ["qid", "chunk_id"], "left")
    )
    names = F.arrays_overlap("asked", I.identifiers(F.col("section"), F.col("form")))
    near = F.coalesce("distance", F.lit(1.0)) <= settings.veto_distance
    return rows.where(F.col("searched").isNull() | near | names).select(*gated.columns)


def fuse(ranked_lexical: DataFrame, ranked_vector: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(qid, chunk_id, rrf, lex_rank, vec_rank) out of (qid, chunk_id, rank) lists.

    Order is by rrf, then lexical rank, then vector rank. A key that a list repeats adds twice.
    """
    k = settings.rrf_k
    none = F.lit(None).cast("int")
    a = ranked_lexical.select("qid", "chunk_id", F.col("rank").alias("lex_rank"), none.alias("vec_rank"), "rank")
    b = ranked_vector.select("qid", "chunk_id", none.alias("lex_rank"), F.col("rank").alias("vec_rank"), "rank")
    return a.unionByName(b).groupBy("qid", "chunk_id").agg(
        F.round(F.sum(F.lit(1.0) / (k + F.col("rank"))), 12).alias("rrf"),
        F.min("lex_rank").alias("lex_rank"),
        F.min("vec_rank").alias("vec_rank"),
    )


def diversify(ranked: DataFrame, limit: int = DEFAULTS.evidence, settings: Settings = DEFAULTS) -> DataFrame:
    """At most ``per_section`` chunks of one form and section first, then the others in rank order.

    ``ranked`` has qid, rank, form and section; the result's rank is the final one.
    """
    group = Window.partitionBy("qid", F.coalesce("form", F.lit("")), F.coalesce("section", F.lit(""))).orderBy("rank")
    over = F.row_number().over(group) > settings.per_section
    final = F.row_number().over(Window.partitionBy("qid").orderBy("over", "rank"))
    rows = ranked.withColumn("over", over).withColumn("final", final)
    return rows.where(F.col("final") <= limit).drop("over", "rank").withColumnRenamed("final", "rank")


def _ranked(rows: DataFrame, *order) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))


def retrieve(questions: DataFrame, index: Index | lexical.Stored, hits: DataFrame | None = None, limit: int = DEFAULTS.evidence, settings: Settings = DEFAULTS) -> DataFrame:
    """(qid, rank, chunk_id, rrf): the evidence of each question; none means it is declined.

    ``hits`` are (qid, chunk_id, distance, vec_rank). Ranks are positions in the filtered lists: the
    gate and the veto come before any order, so only what passed them is sorted.
    """
    gated = lexical.relevances(questions, index, settings, gate=True)
    if hits is None:
        hits = questions.sparkSession.createDataFrame([], "qid string, chunk_id string, distance double, vec_rank int")
    kept = lexical_veto(gated, hits, questions, index.chunks, settings)
    near = hits.where(F.col("distance") <= settings.max_distance)
    fused = fuse(_ranked(kept, F.desc("relevance"), "corpus_pos"), _ranked(near, "vec_rank"), settings)
    ordered = _ranked(fused, F.desc("rrf"), F.asc_nulls_last("lex_rank"), F.asc_nulls_last("vec_rank"))
    named = ordered.join(index.chunks.select("chunk_id", "form", "section"), "chunk_id")
    return diversify(named, limit, settings).select("qid", "rank", "chunk_id", "rrf")
