"""Exact nearest neighbours by cosine distance, and the embedders that can feed them.

A stated query set is compared with all rows: each Arrow batch of vectors is one matrix
product with each block of queries, only the best few of a task leave it, and the final
rank is taken over those.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.config import DEFAULTS, Settings
from gneiss.functions.optional import require

#: Queries and rows of one matrix product; rows and bytes of queries that one task holds.
QUERY_BLOCK, ROW_BLOCK, QUERY_ROWS, QUERY_BYTES = 256, 2048, 16_384, 64 << 20
#: Texts that are embedded together.
EMBED_ROWS = 512
FOUND = "qid string, chunk_id string, corpus_pos long, distance double"
#: Of a batch of rows the distances to blocks of queries, with the number of each block's first query; infinite where not to be compared.
Compare = Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]]
Ready = Callable[[pa.Table], Compare]


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray:
        """One row of floats for each text."""


class HashedTerms:
    """A deterministic bag-of-terms embedder; a stand-in where no model is at hand."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in (text or "").lower().split():
                code = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[code % self.dimensions] += 1 if code >> 63 else -1
        return out


class SentenceModel:
    """Vectors of a sentence-embedding model, loaded once in each process that embeds."""

    _loaded: dict[str, object] = {}

    def __init__(self, model: str):
        self.model = model

    def embed(self, texts: list[str]) -> np.ndarray:
        if self.model not in self._loaded:
            library = require("sentence_transformers", "embedding texts with a model")
            self._loaded[self.model] = library.SentenceTransformer(self.model)
        return np.asarray(self._loaded[self.model].encode(texts), np.float32)


def embed(df: DataFrame, embedder: Embedder, text_col: str = "text", out_col: str = "embedding") -> DataFrame:
    """``df`` with its texts' vectors; ``embedder`` is sent to the executors. Texts become strings of Python EMBED_ROWS at a time, however large a batch is."""

    @F.arrow_udf("array<float>")
    def vectors(texts: pa.Array) -> pa.Array:
        parts = [pa.array([], pa.list_(pa.float32()))]
        for at in range(0, len(texts), EMBED_ROWS):
            some = np.asarray(embedder.embed(texts.slice(at, EMBED_ROWS).fill_null("").to_pylist()), np.float32)
            ends = np.arange(len(some) + 1, dtype=np.int32) * some.shape[1]
            parts.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(some.ravel())))
        return pa.concat_arrays(parts)

    return df.withColumn(out_col, vectors(text_col))


def cosine_distance(a: Column, b: Column) -> Column:
    """The distance as a plain expression, for joins that already pair the vectors."""
    product = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.lit(1.0) - product(a, b) / F.sqrt(product(a, a) * product(b, b))


def nearest(queries: DataFrame, vectors: DataFrame, limit: int = DEFAULTS.candidates, scoped: bool = False) -> DataFrame:
    """(qid, chunk_id, distance, vec_rank): the ``limit`` nearest rows of each query.

    ``queries`` has qid and embedding, ``vectors`` chunk_id, corpus_pos and embedding; with
    ``scoped`` both have scope, and only rows of one scope are compared. Rows without a vector
    are never near. Ties go to the earlier corpus position.
    """
    scope = ["scope"] if scoped else []
    asked = queries.where("embedding is not null").select("qid", "embedding", *scope)
    rows = vectors.where("embedding is not null").select("chunk_id", F.col("corpus_pos").cast("long").alias("corpus_pos"), "embedding", *scope)
    found = compared(asked, rows, functools.partial(_cosine, scoped), limit)
    order = Window.partitionBy("qid").orderBy("distance", "corpus_pos")
    return found.withColumn("vec_rank", F.row_number().over(order)).where(F.col("vec_rank") <= limit).drop("corpus_pos")


def _cosine(scoped: bool, asked: pa.Table) -> Compare:
    matrix = unit_rows(asked.column("embedding").combine_chunks())
    scopes = np.array(asked.column("scope").to_pylist(), object) if scoped else None

    def compare(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        rows = unit_rows(batch.column("embedding"))
        own = np.array(batch.column("scope").to_pylist(), object) if scoped else None
        for at in range(0, len(matrix), QUERY_BLOCK):
            distance = np.round(1.0 - matrix[at : at + QUERY_BLOCK] @ rows.T, 12) + 0.0  # no negative zero
            yield at, np.where(scopes[at : at + QUERY_BLOCK, None] == own[None], distance, np.inf) if scoped else distance

    return compare


def unit_rows(lists: pa.ListArray) -> np.ndarray:
    """The vectors of a list column as rows of length one."""
    rows = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def best_of(distance: np.ndarray, position: np.ndarray, limit: int) -> np.ndarray:
    """Columns of the ``limit`` least distances of each row, ties to the lesser position, in no order."""
    n = distance.shape[1]
    if n <= limit:
        return np.broadcast_to(np.arange(n), distance.shape)
    edge = np.partition(distance, limit - 1, axis=1)[:, limit - 1 : limit]
    # Below the edge all are in; of those on it, the first by position.
    rank = np.where(distance < edge, -np.inf, np.where(distance == edge, position.astype(np.float64), np.inf))
    return np.argpartition(rank, limit - 1, axis=1)[:, :limit]


class _Best:
    """The best few rows of each query of a table, as batches of rows come by."""

    def __init__(self, asked: pa.Table, ready: Ready, limit: int):
        self.qids, self.compare, self.limit = asked.column("qid").to_pylist(), ready(asked), limit
        self.held: dict[int, tuple] = {}

    def add(self, batch: pa.RecordBatch) -> None:
        for at in range(0, batch.num_rows, ROW_BLOCK):
            self._add(batch.slice(at, ROW_BLOCK))

    def _add(self, batch: pa.RecordBatch) -> None:
        position = batch.column("corpus_pos").to_numpy(zero_copy_only=False)
        names = np.array(batch.column("chunk_id").to_pylist(), object)
        for at, distance in self.compare(batch):
            best = best_of(distance, position, self.limit)
            near = np.take_along_axis(distance, best, 1)
            q, k = np.nonzero(np.isfinite(near))
            new = near[q, k], position[best[q, k]], names[best[q, k]], at + q
            self.held[at] = _merged(self.held.get(at, tuple(c[:0] for c in new)), new, self.limit)

    def rows(self) -> Iterator[pa.RecordBatch]:
        for distance, position, names, q in self.held.values():
            columns = [pa.array([self.qids[i] for i in q], pa.string()), pa.array(names, pa.string()), pa.array(position, pa.int64()), pa.array(distance, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["qid", "chunk_id", "corpus_pos", "distance"])


def compared(queries: DataFrame, rows: DataFrame, ready: Ready, limit: int, most_rows: int = QUERY_ROWS, most_bytes: int = QUERY_BYTES) -> DataFrame:
    """(qid, chunk_id, corpus_pos, distance): of each query the best ``limit`` rows that each task met, by what ``ready`` makes of a table of queries.

    Queries of at most ``most_rows`` rows and ``most_bytes``, checked on the rows themselves, are sent out, and ``rows`` are read where they lie. More queries
    never come to the driver: they are cut into groups of that size and the rows into as many shares as a shuffle has partitions, both by a hash of their id; a task
    gets one group and one share, the group first, and the share streams by it. No key but the ids decides, so none is hot.
    """
    small = queries.limit(most_rows + 1).toArrow()
    if small.num_rows <= most_rows and small.nbytes <= most_bytes:
        sent = rows.sparkSession.sparkContext.broadcast(small)  # most_bytes

        def beside(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if sent.value.num_rows:
                best = _Best(sent.value, ready, limit)
                for batch in batches:
                    if batch.num_rows:
                        best.add(batch)
                yield from best.rows()

        return rows.mapInArrow(beside, FOUND)
    shares = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a_group = min(most_rows, max(most_bytes * small.num_rows // small.nbytes, 1))
    groups = -(-queries.count() // a_group)
    own, every = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)), lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("*", own("qid", groups).alias("group"), every(shares).alias("share"), F.lit(0).alias("side"))
    right = rows.select("*", every(groups).alias("group"), own("chunk_id", shares).alias("share"), F.lit(1).alias("side"))
    both = left.unionByName(right, allowMissingColumns=True).withColumn("cell", (F.col("group") * shares + F.col("share")).cast("int"))
    met = both.drop("group", "share").repartitionById(groups * shares, "cell").sortWithinPartitions("side")

    def pass_by(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, best = [], None
        for batch in batches:
            first = int(np.searchsorted(batch.column("side").to_numpy(), 1))  # queries come first
            if first:
                asked.append(batch.slice(0, first))
            if first < batch.num_rows and asked:
                best = best or _Best(pa.Table.from_batches(asked), ready, limit)
                best.add(batch.slice(first))
        if best:
            yield from best.rows()

    return met.mapInArrow(pass_by, FOUND)


def _merged(old: tuple, new: tuple, limit: int) -> tuple:
    """The best ``limit`` of each query out of two lists of (distance, position, name, query)."""
    distance, position, names, q = (np.concatenate(pair) for pair in zip(old, new, strict=True))
    order = np.lexsort((position, distance, q))
    q = q[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    keep = order[rank < limit]
    return distance[keep], position[keep], names[keep], q[rank < limit]


def within_floor(hits: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    return hits.where(F.col("distance") <= settings.max_distance)
