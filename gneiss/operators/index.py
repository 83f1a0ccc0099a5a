"""The lexical index: postings and corpus statistics as tables, one corpus for each scope.

``chunks`` has chunk_id, ticker, section, form, text and corpus_pos, and may have ``terms``, the terms
of its text as a store keeps them; only where it has none are texts read. A scope is a company, or
the whole store where ``scope`` is None; statistics are always those of the scope.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions import text as T


def scope_column(scope: str | None) -> Column:
    return F.coalesce(F.col(scope), F.lit("")) if scope else F.lit("")


def terms_of(chunks: DataFrame) -> Column:
    """The terms of a chunk's text: those that were stored, else those of the text."""
    told = T.terms(F.col("text"))
    return F.coalesce("terms", told) if "terms" in chunks.columns else told


def tokenized(chunks: DataFrame) -> DataFrame:
    """(chunk_id, ticker, terms)."""
    return chunks.select("chunk_id", "ticker", terms_of(chunks).alias("terms"))


def postings(chunks: DataFrame, scope: str | None = "ticker") -> DataFrame:
    """(scope, chunk_id, term, tf)."""
    rows = chunks.select(scope_column(scope).alias("scope"), "chunk_id", F.explode(terms_of(chunks)).alias("term"))
    return rows.groupBy("scope", "chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def chunk_lengths(chunks: DataFrame, scope: str | None = "ticker") -> DataFrame:
    """(scope, chunk_id, len): terms of each chunk, 0 for chunks without any. No shuffle."""
    return chunks.select(scope_column(scope).alias("scope"), "chunk_id", F.size(terms_of(chunks)).cast("long").alias("len"))


def document_frequency(posted: DataFrame) -> DataFrame:
    """(scope, term, df)."""
    return posted.groupBy("scope", "term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """(scope, n_docs, avg_len): all chunks count, and an average of 0 is taken as 1."""
    average = F.avg("len")
    return lengths.groupBy("scope").agg(
        F.count(F.lit(1)).alias("n_docs"), F.when(average == 0, F.lit(1.0)).otherwise(average).alias("avg_len")
    )


def identifiers(section: Column, form: Column) -> Column:
    """Terms that name a part of the filing: those of the section heading and the form."""
    return F.array_union(T.term_set(section), T.term_set(form))


@dataclass
class Index:
    """What scoring reads: every chunk once, as (scope, chunk_id, name, corpus_pos, terms, heads)."""

    chunks: DataFrame
    tokens: DataFrame

    def matches(self, wanted: DataFrame) -> DataFrame:
        """(scope, chunk_id, name, corpus_pos, len, found, heads) of each chunk in the scopes of ``wanted`` (scope, term).

        ``found`` has (term, tf) of the wanted terms of its text, ``heads`` those of its section heading.
        One pass over the chunks, with nothing exploded: terms that nobody asked for leave it as a length.
        """
        asked = wanted.groupBy("scope").agg(F.collect_set("term").alias("wanted"))  # the terms of a batch of questions
        tf = lambda t: F.size(F.filter("terms", lambda x: x == t)).cast("long")
        found = F.transform(F.array_intersect("terms", "wanted"), lambda t: F.struct(t.alias("term"), tf(t).alias("tf")))
        return self.tokens.join(asked, "scope").select(
            "scope", "chunk_id", "name", "corpus_pos", F.size("terms").cast("long").alias("len"), found.alias("found"),
            F.array_intersect("heads", "wanted").alias("heads"),
        )


def build(chunks: DataFrame, scope: str | None = "ticker") -> Index:
    tokens = chunks.select(
        scope_column(scope).alias("scope"), "chunk_id", F.lower("ticker").alias("name"), "corpus_pos",
        terms_of(chunks).alias("terms"), T.term_set(F.col("section")).alias("heads"),
    )
    return Index(chunks.withColumn("scope", scope_column(scope)), tokens)
