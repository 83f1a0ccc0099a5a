"""Two Bloom filters over all rows: hashes seen once, and hashes seen twice or more.

Every task fills the pair over its own rows and hands on compressed segments; segments
of one number meet in one task, where a bit set in the once-filters of two tasks goes to
the twice-filter too. If a hash is in two tasks, all its bits are in both, so the
twice-filter misses no repeat; it may name a row that has none, which only costs that
row a shuffle. The merged twice-filter alone is sent out. Its size follows the table's
but never passes ``MOST_BITS`` (32 MB); beyond that more rows are suspected, up to all.

Defined results: an empty table, or one without hashes, has an empty filter, which contains nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gneiss.llm.common import arrow

HASHES = 4
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
SEGMENT = 1 << 17  # bytes


def filter_bits(keys: float, per_key: int = 16) -> int:
    """A power of two of bits for about so many keys."""
    bits = LEAST_BITS
    while bits < min(keys * per_key, MOST_BITS):
        bits *= 2
    return bits


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """HASHES rows of bit positions, by double hashing of a 64-bit hash."""
    h = hashes.astype(np.uint64, copy=False)
    step = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)) | np.uint64(1)
    return np.stack([(h + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(HASHES)]).astype(np.int64)


def _pieces(at: np.ndarray, bits: int) -> dict[int, np.ndarray]:
    """Bitmaps of the segments that have a bit set, by segment number."""
    at = np.unique(at)
    width = min(SEGMENT * 8, bits)
    cuts = np.searchsorted(at, np.arange(0, bits + 1, width))
    out = {}
    for number in np.flatnonzero(np.diff(cuts)):
        flags = np.zeros(width, bool)
        flags[at[cuts[number] : cuts[number + 1]] - number * width] = True
        out[int(number)] = np.packbits(flags, bitorder="little")
    return out


def contains(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in the filter."""
    at = positions(hashes, len(bitmap) * 8)
    hit = np.ones(at.shape[1], bool)
    for row in at:
        hit &= (bitmap[row >> 3] >> (row & 7).astype(np.uint8)) & 1 == 1
    return hit


def id_hashes(column: pa.Array) -> np.ndarray:
    """Hashes of whole numbers; null has that of 0."""
    return column.cast(pa.int64()).fill_null(0).to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def id_filter(df: DataFrame, id_col: str):
    """A filter over the ids of ``df``, sent to the executors; at most MOST_BITS."""
    whole = repeated_filter(df, [id_col], lambda b: id_hashes(b.column(0)), filter_bits(df.count()), least=1)
    return df.sparkSession.sparkContext.broadcast(whole)


def repeated_filter(
    df: DataFrame, columns: list[str], hashes: Callable[[pa.RecordBatch], np.ndarray], bits: int, least: int = 2
) -> np.ndarray:
    """The merged filter of hashes seen at least ``least`` (one or two) times in ``df``.

    ``hashes`` gives a batch's 64-bit hashes, each as often as it is to count.
    """
    width = min(SEGMENT, bits // 8)

    def pair(number: int, once: np.ndarray, twice: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "segment": pa.array([number], pa.int32()),
            "once": pa.array([zlib.compress(once.tobytes(), 1)], pa.binary()),
            "twice": pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary()),
        })

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [h for batch in batches if len(h := hashes(batch))]
        if not seen:
            return
        values, counts = np.unique(np.concatenate(seen), return_counts=True)
        once = _pieces(positions(values, bits).ravel(), bits)
        twice = _pieces(positions(values[counts > 1], bits).ravel(), bits)
        for number, bitmap in once.items():
            yield pair(number, bitmap, twice.get(number, np.zeros_like(bitmap)))

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
                if number not in once:
                    once[number], twice[number] = a.copy(), b.copy()
                else:
                    twice[number] |= b | (once[number] & a)
                    once[number] |= a
        for number, bitmap in (twice if least > 1 else once).items():
            if bitmap.any():
                yield pair(number, bitmap, bitmap)

    schema = "segment int, once binary, twice binary"
    parts = arrow(df.select(*columns), fill, schema)
    merged = arrow(parts.repartition(min(bits // 8 // width, 64), "segment"), merge, schema)
    whole = np.zeros(bits // 8, np.uint8)
    for row in merged.select("segment", "once").collect():  # MOST_BITS bounds their sum
        bitmap = np.frombuffer(zlib.decompress(bytes(row["once"])), np.uint8)
        whole[row["segment"] * width :][: len(bitmap)] = bitmap
    return whole
