"""Queries of a store over the driver's tables: documents upserted in three commits, most of them replaced on the way.

The store lies in a folder of its own in the shared one and is made once for each application and folder of tables, and again should it have
been cleared away or its making have failed; each query reads what it is about of it: postings and their bounds, differences of counts, what is kept of the files. The first commit has most documents
with other texts, the second and third have what they should be, so rows are those of a store that was never wrong.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.operators import answer, coded, hybrid, lexical
from gneiss.plans.queries import SETTINGS, chunks, hits, questions
from gneiss.sources.scratch import shared_folder
from gneiss.sources.store import Store
from gneiss.sources.tables import read_table as read

_MADE: dict[tuple[str, str], Store] = {}
_MAKING = threading.Lock()
#: Commits of the store.
COMMITS = 3
_CODED: dict[tuple[str, str], coded.CodedVectors] = {}


def stored_chunks(spark, sf_dir) -> DataFrame:
    """Documents as a store takes them; seq is their order."""
    rows = chunks(spark, sf_dir)
    none = F.lit("")
    accession = F.when(F.col("ticker") == "es", "").otherwise(F.concat("ticker", "section"))
    return rows.select(
        "chunk_id", F.lit(0).alias("chunk_index"), F.when(F.col("corpus_pos") % 10 == 3, "table").otherwise("text").alias("chunk_type"), none.alias("table_title"),
        "ticker", "form", none.alias("filing_date"), none.alias("period_of_report"), accession.alias("accession_number"), "section", "text",
        none.alias("source_url"), none.alias("document_name"), F.col("corpus_pos").alias("seq"),
    )


def made_store(spark, sf_dir) -> Store:
    """The store of a folder of tables. Of queries that ask at once the first makes it; what one that was stopped has left is never built upon."""
    key = (spark.sparkContext.applicationId, sf_dir)
    with _MAKING:
        if key not in _MADE or not _MADE[key].is_whole(COMMITS):
            store, rows = Store(spark, f"{shared_folder(spark)}/gneiss-store-{uuid.uuid4().hex}-{key[0]}"), stored_chunks(spark, sf_dir)
            wrong = F.col("seq") % 3 != 0
            stale = F.when(wrong, F.concat(F.substring("text", 1, 200), F.lit(" superseded wording of it"))).otherwise(F.col("text"))
            store.upsert(rows.withColumn("text", stale))
            store.upsert(rows.where("seq % 2 = 0"))
            store.upsert(rows.where(wrong & (F.col("seq") % 2 == 1)))
            _MADE[key] = store
        return _MADE[key]


def _shown(rows):
    return rows.select("qid", "chunk_id", F.round("relevance", 6).alias("relevance"), "gate", F.round("coverage", 6).alias("coverage"), "lex_rank")


def indexed_rank(spark, sf_dir):
    """bm25_rank, out of the postings of the questions' terms."""
    return _shown(lexical.score(questions(spark), made_store(spark, sf_dir).index(), SETTINGS))


def indexed_retrieve(spark, sf_dir):
    """retrieve_lexical, without the blocks that cannot hold one of the best."""
    return _shown(lexical.retrieve(questions(spark), made_store(spark, sf_dir).index(), 3, SETTINGS))


def indexed_product(spark, sf_dir):
    """The best three chunks of a question for each turn of the conversations: a large batch, as a product in blocks."""
    turns = read(spark, sf_dir, "conversations")
    asked = turns.select(F.concat_ws(":", "conv_id", "turn").alias("qid"), F.col("text").alias("question"), F.lit("en").alias("scope"))
    index = made_store(spark, sf_dir).index()
    return _shown(index.named(index.product(asked, 3, SETTINGS)))


def indexed_answers(spark, sf_dir):
    """answer_extractive from a store."""
    index = made_store(spark, sf_dir).index()
    evidence = hybrid.retrieve(questions(spark), index, hits(spark, sf_dir), 3, SETTINGS)
    rows = answer.extractive(questions(spark), evidence, index.chunks.drop("filing_date", "source_url", "period_of_report"), SETTINGS)
    return rows.select(
        "qid", "answer", "supported", F.array_join("citations", "; ").alias("citations"),
        F.size("evidence").cast("long").alias("n_evidence"), "why_it_matters",
    )


def stored_frequency(spark, sf_dir):
    """document_frequency, as the differences of three commits add up to it."""
    rows = made_store(spark, sf_dir).index().differences.groupBy(F.col("ticker").alias("scope"), "term").agg(F.sum("df").alias("df"))
    return rows.where("df <> 0")


def stored_totals(spark, sf_dir):
    """corpus_stats, likewise."""
    rows = made_store(spark, sf_dir).index().totals.groupBy(F.col("ticker").alias("scope")).agg(F.sum("n_docs").alias("n_docs"), F.sum("total_len").alias("total_len"))
    average = F.col("total_len") / F.col("n_docs")
    return rows.where("n_docs <> 0").select("scope", "n_docs", F.round(F.when(average == 0, 1.0).otherwise(average), 6).alias("avg_len"))


def stored_companies(spark, sf_dir):
    """indexed_companies, without a chunk being read."""
    return made_store(spark, sf_dir).companies().withColumn("forms", F.array_join("forms", ","))


def stored_stats(spark, sf_dir):
    """store_stats with its tables, likewise."""
    store = made_store(spark, sf_dir)
    rows = store.stats().withColumn("forms", F.array_join("forms", ",")).withColumn("tickers", F.array_join("tickers", ","))
    return rows.join(store.table_counts().select("tables", F.expr("tables + prose").alias("chunks")), "chunks")


def stored_order(spark, sf_dir):
    """The order of a store's chunks: replaced ones keep the place at which they first came."""
    rows = made_store(spark, sf_dir).scan()
    return rows.select("chunk_id", "corpus_pos", F.length("text").cast("long").alias("n_chars"))


def _coded(spark, sf_dir):
    """Queries (ids divisible by 100, strings) and the codes of all vectors."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("vec_id").alias("corpus_pos"), "embedding")
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CODED:
        _CODED[key] = coded.CodedVectors.build(rows, f"{shared_folder(spark)}/gneiss-codes-{len(_CODED)}-{key[0]}")
    return rows.where("corpus_pos % 100 = 0").select(F.col("chunk_id").alias("qid"), "embedding"), _CODED[key]


def knn_coded(spark, sf_dir):
    """knn_exact, of the tenth of the vectors at most that the codes find: most of its rows."""
    queries, codes = _coded(spark, sf_dir)
    return codes.nearest(queries, 10).select("qid", "chunk_id", F.round("distance", 6).alias("distance"), "vec_rank")


QUERIES = {f.__name__: f for f in (
    indexed_rank, indexed_retrieve, indexed_product, indexed_answers, stored_frequency, stored_totals, stored_companies, stored_stats, stored_order, knn_coded,
)}
