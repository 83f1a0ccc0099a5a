"""Entry points: a batch of questions against a store of chunks, in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.config import DEFAULTS, Settings
from gneiss.functions.sizes import if_small
from gneiss.operators import answer as A
from gneiss.operators import hybrid, index, lexical, vector


def asked(questions: DataFrame, scoped: bool) -> DataFrame:
    """Questions with their scope: the ticker asked about, or everything. Blank questions ask nothing."""
    scope = F.upper(F.coalesce("ticker", F.lit(""))) if scoped else F.lit("")
    return questions.where(F.trim(F.coalesce("question", F.lit(""))) != "").withColumn("scope", scope)


def search(questions: DataFrame, chunks: DataFrame, embedder: vector.Embedder, scoped: bool = True, settings: Settings = DEFAULTS) -> DataFrame:
    """Vector hits of each question among chunks with an embedding."""
    queries = vector.embed(asked(questions, scoped), embedder, "question")
    rows = chunks.withColumn("scope", F.coalesce("ticker", F.lit("")) if scoped else F.lit(""))
    return vector.nearest(queries, rows, settings.candidates, scoped)


def answer(
    questions: DataFrame,
    chunks: DataFrame,
    hits: DataFrame | None = None,
    generator: A.Generator | None = None,
    scoped: bool = True,
    settings: Settings = DEFAULTS,
    embedder: vector.Embedder | None = None,
    stored: lexical.Stored | None = None,
) -> DataFrame:
    """One answer for each question (qid, question, ticker) from chunks with ``corpus_pos``.

    With an embedder, and chunks that have vectors of it, retrieval is hybrid; vector hits may also be
    given. Without either it is lexical alone. A generator only ever sees approved evidence,
    is called once a question, and can narrow what is answered, never widen it. With a store's index (of the same
    scopes) the chunks are read only for what the answers show.
    """
    batch, chunks = asked(questions, scoped), hybrid.keyed(chunks)
    evidence = retrieve(questions, chunks, hits, scoped, settings, embedder, stored)
    if stored is not None:
        small = if_small(evidence, 1000)
        if small is not None:  # as a filter it reaches the files
            evidence, chunks = small, chunks.where(F.col("chunk_id").isin([r.chunk_id for r in small.collect()]))
    if generator is None:
        return A.extractive(batch, evidence, chunks, settings)
    return A.generated(batch, evidence, chunks, A.write_answers(batch, evidence, chunks, generator), settings)


def retrieve(
    questions: DataFrame,
    chunks: DataFrame,
    hits: DataFrame | None = None,
    scoped: bool = True,
    settings: Settings = DEFAULTS,
    embedder: vector.Embedder | None = None,
    stored: lexical.Stored | None = None,
) -> DataFrame:
    """(qid, rank, chunk_id, rrf): the evidence that ``answer`` answers from."""
    chunks = hybrid.keyed(chunks)
    if hits is None and embedder is not None:
        hits = search(questions, chunks, embedder, scoped, settings)
    found = stored if stored is not None else index.build(chunks, "ticker" if scoped else None)
    return hybrid.retrieve(asked(questions, scoped), found, hits, settings.evidence, settings)
