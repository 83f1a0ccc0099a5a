"""Vectors of texts by latent terms: a truncated singular value decomposition of a corpus's tf-idf matrix.

Terms are hashed into ``BUCKETS`` columns. Document frequencies are counted over all rows. The decomposition is fitted on a
sample of some ``SAMPLE`` rows, those whose hashed id is least (all rows of a smaller corpus), by randomised subspace iteration: in each round every task multiplies
its rows A with the basis Q and the product with its rows' transpose, and these A'AQ are summed by blocks of columns. Only
matrices of buckets by dimensions come to the driver, 21 MB at most; the rows never do.

Null and empty texts, and texts of words that the sample does not have, get the vector of zeros. With fewer rows or terms than ``dimensions`` the
last dimensions are zeros; of a table without rows all are.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions.text import STOP_WORDS

BUCKETS, SAMPLE, DIMENSIONS, SPARE, ROUNDS = 1 << 16, 1 << 16, 64, 16, 3
#: Buckets of one block of sums, rows of one product, and rows of the sample in a task; texts are taken as many at a time as a product has rows.
_BLOCK, _ROWS, _TASK_ROWS = 1024, 128, 32_768
SAVED = "bucket long, rarity float, direction array<float>, strength array<double>"
_WORD = re.compile(r"[a-z0-9]{3,}")


@dataclass(frozen=True)
class Sparse:
    """Rows of a sparse matrix: where each begins, its columns and their values."""

    begin: np.ndarray
    column: np.ndarray
    value: np.ndarray

    def times(self, dense: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.begin) - 1, dense.shape[1]), np.float64)
        for at in range(0, len(out), _ROWS):
            begin = self.begin[at : at + _ROWS + 1]
            own = slice(begin[0], begin[-1])
            some = begin[1:] > begin[:-1]
            if some.any():
                out[at : at + _ROWS][some] = np.add.reduceat(dense[self.column[own]] * self.value[own, None], begin[:-1][some] - begin[0])
        return out

    def add_transposed(self, dense: np.ndarray, out: np.ndarray) -> None:
        for at in range(0, len(dense), _ROWS):
            begin = self.begin[at : at + _ROWS + 1]
            own = slice(begin[0], begin[-1])
            if begin[0] == begin[-1]:
                continue
            row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
            order = np.argsort(self.column[own], kind="stable")
            columns, first = np.unique(self.column[own][order], return_index=True)
            out[columns] += np.add.reduceat((dense[at : at + _ROWS][row] * self.value[own, None])[order], first)


def term_counts(texts: Iterable[str | None]) -> Sparse:
    """How often each text has terms of each bucket."""
    columns, counts = [], []
    for text in texts:
        own: Counter[int] = Counter()
        for word, n in Counter(_WORD.findall((text or "").lower())).items():
            if word not in STOP_WORDS:
                own[zlib.crc32(word.removesuffix("s").encode()) % BUCKETS] += n
        columns.append(np.fromiter(own.keys(), np.int32, len(own)))
        counts.append(np.fromiter(own.values(), np.float32, len(own)))
    begin = np.cumsum([0, *(len(c) for c in columns)])
    return Sparse(begin, np.concatenate([np.zeros(0, np.int32), *columns]), np.concatenate([np.zeros(0, np.float32), *counts]))


def _some(column: pa.Array) -> Iterator[list[str | None]]:
    for at in range(0, len(column), _ROWS):
        yield column.slice(at, _ROWS).to_pylist()


def weighted(counts: Sparse, rarity: np.ndarray) -> Sparse:
    """Rows of length one of (1 + log count) times rarity."""
    value = (1 + np.log(counts.value)) * rarity[counts.column]
    row = np.repeat(np.arange(len(counts.begin) - 1), np.diff(counts.begin))
    length = np.sqrt(np.bincount(row, value**2, len(counts.begin) - 1))
    return Sparse(counts.begin, counts.column, value / np.maximum(length, 1e-300)[row])


@dataclass(frozen=True)
class LatentTerms:
    """An embedder: ``rarity`` of each bucket, and the fitted directions as columns of ``basis``."""

    rarity: np.ndarray
    basis: np.ndarray
    strength: np.ndarray  # singular values on the sample

    def embed(self, texts: list[str]) -> np.ndarray:
        parts = [weighted(term_counts(texts[at : at + _ROWS]), self.rarity).times(self.basis) for at in range(0, len(texts), _ROWS)]
        return np.concatenate([np.zeros((0, self.basis.shape[1])), *parts]).astype(np.float32)

    def save(self, spark: SparkSession, path: str) -> None:
        """Written as Parquet, a row for each bucket that occurred; ``strength`` stands in all of them."""
        own = np.flatnonzero(self.basis.any(axis=1))
        direction = pa.array(list(self.basis[own]), pa.list_(pa.float32()))
        strength = pa.array([self.strength.tolist()] * len(own), pa.list_(pa.float64()))
        rows = pa.table([pa.array(own), pa.array(self.rarity[own]), direction, strength], ["bucket", "rarity", "direction", "strength"])
        spark.createDataFrame(rows, SAVED).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LatentTerms:
        """As saved; a bucket that never occurred has no direction, so what it weighs changes no angle."""
        rows = spark.read.schema(SAVED).parquet(path).toArrow()  # BUCKETS rows at most
        at = rows.column("bucket").to_numpy()
        strength = np.array(rows.column("strength")[0].as_py() if len(at) else np.zeros(DIMENSIONS))
        rarity, basis = np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, len(strength)), np.float32)
        rarity[at], basis[at] = rows.column("rarity").to_numpy(), np.array(rows.column("direction").to_pylist(), np.float32).reshape(len(at), len(strength))
        return cls(rarity, basis, strength)


def _summed(rows: DataFrame, width: int, kind: type, add: Callable[[pa.RecordBatch, np.ndarray], None]) -> np.ndarray:
    """The sum over all rows of what ``add`` adds of a batch to a matrix of BUCKETS by ``width``; a task hands on its sums as ``kind``, of the buckets that it met."""

    def own(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((BUCKETS, width))
        for batch in batches:
            add(batch, out)
        for at in range(0, BUCKETS, _BLOCK):
            yield from block(at, out[at : at + _BLOCK])

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, met, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums.setdefault(at, np.zeros((_BLOCK, width)))[np.frombuffer(met, np.int16)] += np.frombuffer(data, kind).reshape(-1, width)
        for at, data in sums.items():
            yield from block(at, data)

    def block(at: int, data: np.ndarray) -> Iterator[pa.RecordBatch]:
        met = np.flatnonzero(data.any(axis=1)).astype(np.int16)
        if len(met):
            parts = [pa.array([x.tobytes()], pa.binary()) for x in (met, data[met].astype(kind))]
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), *parts], ["at", "met", "data"])

    schema = "at int, met binary, data binary"
    whole = np.zeros((BUCKETS, width))
    tasks = min(BUCKETS // _BLOCK, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    for row in rows.mapInArrow(own, schema).repartition(tasks, "at").mapInArrow(meet, schema).collect():  # one matrix
        whole[row["at"] + np.frombuffer(bytes(row["met"]), np.int16).astype(np.int64)] = np.frombuffer(bytes(row["data"]), kind).reshape(-1, width)
    return whole


def _add_frequency(batch: pa.RecordBatch, out: np.ndarray) -> None:
    for texts in _some(batch.column("text")):
        np.add.at(out[:, 0], term_counts(texts).column, 1)


def fit(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", dimensions: int = DIMENSIONS, sample: int = SAMPLE, seed: int = 0) -> LatentTerms:
    """The embedder of a corpus; reads it twice, once for frequencies and once for the sample."""
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = df.count()
    rarity = np.log((1 + rows) / (1 + _summed(texts.select("text"), 1, np.float64, _add_frequency)[:, 0]))
    share = min(sample / max(rows, 1), 1.0)
    chosen = texts.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _some(batch.column("text")):
                rows = weighted(term_counts(some), rarity)
                parts = [x.tobytes() for x in (rows.begin.astype(np.int64), rows.column.astype(np.int32), rows.value.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in parts], ["begin", "column", "value"])

    tasks = max(-(-min(rows, sample) // _TASK_ROWS), 1)
    chosen = chosen.select("text").mapInArrow(weigh, "begin binary, column binary, value binary").repartition(tasks)
    # A lost executor's part of the sample is made again from the texts.
    matrix = chosen.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        basis = np.random.default_rng(seed).standard_normal((BUCKETS, dimensions + SPARE))
        for _ in range(ROUNDS):
            basis = np.linalg.qr(_gram_times(matrix, basis))[0]
        product = _gram_times(matrix, basis)
    finally:
        matrix.unpersist()
    value, turn = np.linalg.eigh(basis.T @ product)
    strength = np.sqrt(np.maximum(value[::-1][:dimensions], 0))
    directions = basis @ turn[:, ::-1][:, :dimensions]
    directions *= strength > 1e-6 * max(strength.max(initial=0), 1e-300)  # what is no direction of the rows is chance
    return LatentTerms(rarity.astype(np.float32), directions.astype(np.float32), strength)


def _gram_times(matrix: DataFrame, basis: np.ndarray) -> np.ndarray:
    sent = matrix.sparkSession.sparkContext.broadcast(basis.astype(np.float32))  # BUCKETS by dimensions

    def add(batch: pa.RecordBatch, out: np.ndarray) -> None:
        for begin, column, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = Sparse(np.frombuffer(begin, np.int64), np.frombuffer(column, np.int32), np.frombuffer(value, np.float32))
            own.add_transposed(own.times(sent.value).astype(np.float32), out)

    try:
        return _summed(matrix, basis.shape[1], np.float32, add)
    finally:
        sent.destroy()
