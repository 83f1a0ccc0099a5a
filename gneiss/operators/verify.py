"""Citation verification: a quote counts only if the cited chunk says it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions import text as T

NOT_PROVIDED = "cited an evidence id that was not provided"
NOT_THERE = "quote does not appear in the cited evidence"


def verify(citations: DataFrame, evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each citation (qid, pos, chunk_id, quote) with its chunk's metadata and a reason, null if verified.

    ``evidence`` is what a question was given (qid, chunk_id). Of chunks that repeat an id the last
    counts, by corpus_pos where there is one. An empty quote is in every text.
    """
    shown = ["section", "form", "filing_date", "period_of_report", "source_url", "text"]
    have = [F.coalesce(F.col(c), F.lit("")).alias(c) if c in chunks.columns else F.lit("").alias(c) for c in shown]
    last = F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc("corpus_pos") if "corpus_pos" in chunks.columns else F.desc("text")))
    known = chunks.select("chunk_id", *have, last.alias("_n")).where("_n = 1").drop("_n")
    given = evidence.select("qid", "chunk_id").distinct().withColumn("given", F.lit(True))
    rows = citations.join(given, ["qid", "chunk_id"], "left").join(known, "chunk_id", "left")
    there = T.normalize_quote(F.col("text")).contains(T.normalize_quote(F.col("quote")))
    reason = F.when(F.col("given").isNull() | F.col("text").isNull(), NOT_PROVIDED).when(~there, NOT_THERE)
    quote = F.when(reason.isNull(), F.regexp_replace(F.coalesce("quote", F.lit("")), r"(?U)^\s+|\s+$", "")).otherwise(F.col("quote"))
    return rows.select("qid", "pos", "chunk_id", quote.alias("quote"), *shown[:-1], reason.alias("reason"))
