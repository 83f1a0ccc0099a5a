"""Approximate nearest neighbours by codes, with exact distances for what they find.

Unit vectors lie in coarse cells by k-means. What is left of a vector beside its cell's centre is cut into ``PARTS`` parts, and each
part's space into ``CELLS`` cells; a vector's code is the number of its cell in each part, a byte each. Parts and cells are fitted on at most ``SAMPLE`` rows, those of the least hash of
their id; every row is coded. The table of codes is partitioned by coarse cell. A question is compared with the codes of all coarse cells, or of the ``probes`` nearest ones, which alone are read, by the
sum of its products with the coarse centre and the parts' cells; the best ``candidates`` of these are read as vectors and compared
exactly, so distances and order are those of ``vector.nearest`` among what was found. That is the exact way beside this.

Coarse cells save reading where vectors lie in clusters. On vectors without any, ten neighbours of one lie in most cells: then
the codes of all cells are read, a sixteenth of the vectors' bytes, and of the vectors the candidates alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.config import DEFAULTS
from gneiss.operators.vector import Compare, compared, unit_rows

PARTS, CELLS, COARSE, SAMPLE, ROUNDS = 16, 256, 64, 65_536, 15
#: Vectors that are compared exactly for each neighbour asked for.
CANDIDATES = 10
CODED = "chunk_id string, corpus_pos bigint, code binary, cell int"


def k_means(rows: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Centres of at most k clusters; one that loses its rows keeps its place."""
    unique = np.unique(rows, axis=0)
    centres = unique[np.random.default_rng(seed).permutation(len(unique))[:k]]
    for _ in range(ROUNDS):
        own = nearest_centre(rows, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        counts = np.bincount(own, minlength=len(centres))
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest_centre(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    size = (centres**2).sum(axis=1)
    return np.concatenate([(size - 2 * rows[at : at + 8192] @ centres.T).argmin(axis=1) for at in range(0, max(len(rows), 1), 8192)])


def _near_cells(unit: np.ndarray, book: Codebook, probes: int | None) -> np.ndarray:
    """The ``probes`` coarse cells nearest to each vector; all of them if None."""
    return np.argsort(-(unit @ book.coarse.T), axis=1)[:, :probes]


@dataclass(frozen=True)
class Codebook:
    """What vectors are coded by: centres of the coarse cells, and of each part's cells of what is left to the vector beside its coarse centre."""

    parts: list[np.ndarray]
    coarse: np.ndarray

    @property
    def cuts(self) -> list[int]:
        return np.cumsum([0, *(p.shape[1] for p in self.parts)]).tolist()

    def codes(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell numbers of each row, and its coarse cell."""
        cuts, cell = self.cuts, nearest_centre(unit, self.coarse)[: len(unit)]
        rest = unit - self.coarse[cell]
        return np.stack([nearest_centre(rest[:, a:b], p) for a, b, p in zip(cuts, cuts[1:], self.parts, strict=False)], 1).astype(np.uint8), cell

    def products(self, unit: np.ndarray) -> list[np.ndarray]:
        """Of each part, the products of queries with all cells."""
        cuts = self.cuts
        return [unit[:, a:b] @ p.T for a, b, p in zip(cuts, cuts[1:], self.parts, strict=False)]


def fit(vectors: DataFrame, id_col: str = "chunk_id") -> Codebook | None:
    """The codebook of a table's vectors, from SAMPLE rows at most; None of a table without vectors."""
    rows = vectors.where("embedding is not null").select(F.xxhash64(id_col).alias("h"), "embedding").orderBy("h").limit(SAMPLE).toArrow()
    if not rows.num_rows:
        return None
    unit = unit_rows(rows.column("embedding").combine_chunks())
    edges = np.linspace(0, unit.shape[1], min(PARTS, unit.shape[1]) + 1).astype(int)
    coarse = k_means(unit, COARSE)
    rest = unit - coarse[nearest_centre(unit, coarse)]
    return Codebook([k_means(rest[:, a:b], CELLS) for a, b in zip(edges, edges[1:], strict=False)], coarse)


def coded(vectors: DataFrame, book: Codebook) -> DataFrame:
    """CODED of every row that has a vector."""
    sent = vectors.sparkSession.sparkContext.broadcast(book)  # CELLS and COARSE times the dimensions

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = unit_rows(batch.column(2))
            codes, cells = sent.value.codes(unit)
            columns = [batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(cells, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["chunk_id", "corpus_pos", "code", "cell"])

    rows = vectors.where("embedding is not null").select("chunk_id", F.col("corpus_pos").cast("long").alias("corpus_pos"), "embedding")
    return rows.mapInArrow(run, CODED)


class CodedVectors:
    """Codes of a table of vectors in a folder, partitioned by coarse cell, and the vectors themselves."""

    def __init__(self, spark: SparkSession, path: str, vectors: DataFrame, book: Codebook):
        self.spark, self.path, self.vectors, self.book = spark, path, vectors, book

    @classmethod
    def build(cls, vectors: DataFrame, path: str) -> CodedVectors | None:
        """Fit, code and write; ``vectors`` has chunk_id, corpus_pos and embedding, and is read again for candidates."""
        book = fit(vectors)
        if book is None:
            return None
        coded(vectors, book).hint("rebalance", "cell").sortWithinPartitions("cell").write.mode("overwrite").partitionBy("cell").parquet(path)
        return cls(vectors.sparkSession, path, vectors, book)

    def found(self, queries: DataFrame, limit: int, probes: int | None = None) -> DataFrame:
        """(qid, chunk_id): the ``limit`` best rows of each query by their codes, in the ``probes`` coarse cells nearest to it."""
        asked, dimensions = queries.where("embedding is not null").select("qid", "embedding"), self.book.cuts[-1]
        rows = self.spark.read.schema(CODED).parquet(self.path)
        sent = self.spark.sparkContext.broadcast(self.book)

        def cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near = _near_cells(unit_rows(batch.column("embedding")).reshape(-1, dimensions), sent.value, probes)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(near), pa.int32())], ["cell"])

        if probes is not None:
            probed = asked.select("embedding").mapInArrow(cells, "cell int").distinct().collect()  # COARSE at most
            rows = rows.where(F.col("cell").isin([r["cell"] for r in probed]))

        def ready(asked: pa.Table) -> Compare:
            book, unit = sent.value, unit_rows(asked.column("embedding").combine_chunks()).reshape(-1, dimensions)
            near = _near_cells(unit, book, probes)
            allowed = np.zeros((len(unit), len(book.coarse)), bool)
            np.put_along_axis(allowed, near, True, axis=1)

            def compare(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
                code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                cell = batch.column("cell").to_numpy(zero_copy_only=False).astype(np.int64)
                for at in range(0, len(unit), 256):
                    block = unit[at : at + 256]
                    far = 1.0 - (block @ book.coarse.T)[:, cell] - sum(p[:, code[:, k]] for k, p in enumerate(book.products(block)))
                    yield at, np.where(allowed[at : at + 256][:, cell], far, np.inf)

            return compare

        best = Window.partitionBy("qid").orderBy("distance", "corpus_pos")
        near = compared(asked, rows, ready, limit)
        return near.withColumn("n", F.row_number().over(best)).where(F.col("n") <= limit).select("qid", "chunk_id")

    def nearest(self, queries: DataFrame, limit: int = DEFAULTS.candidates, probes: int | None = None, candidates: int | None = None) -> DataFrame:
        """(qid, chunk_id, distance, vec_rank), as ``vector.nearest`` gives them, of the candidates that the codes find."""
        found = self.found(queries, candidates or limit * CANDIDATES, probes)
        rows = self.vectors.where("embedding is not null").select("chunk_id", "corpus_pos", "embedding").join(found, "chunk_id")
        pairs = rows.join(queries.select("qid", F.col("embedding").alias("asked")), "qid")

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    far = np.round(1.0 - (unit_rows(batch.column("asked")) * unit_rows(batch.column("embedding"))).sum(axis=1), 12) + 0.0
                    yield pa.RecordBatch.from_arrays([batch.column("qid"), batch.column("chunk_id"), batch.column("corpus_pos"), pa.array(far)], ["qid", "chunk_id", "corpus_pos", "distance"])

        exact = pairs.select("qid", "chunk_id", F.col("corpus_pos").cast("long").alias("corpus_pos"), "asked", "embedding")
        exact = exact.mapInArrow(run, "qid string, chunk_id string, corpus_pos long, distance double")
        order = Window.partitionBy("qid").orderBy("distance", "corpus_pos")
        return exact.withColumn("vec_rank", F.row_number().over(order)).where(F.col("vec_rank") <= limit).drop("corpus_pos")
