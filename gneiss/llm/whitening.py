"""Whitening of embeddings by a tiled covariance.

Vectors become whole numbers x = floor(256 c); the fit is over each distinct one once. Its rows are cut into row blocks
and their columns into blocks of TILE dimensions. Pairs of column blocks are the tiles of the covariance; tiles
are dealt into squares of SQUARE column blocks a side. Each column block goes, keyed by row block and square, to the squares
that need it (one, up to TILE * SQUARE dimensions), where the centred blocks of a tile are multiplied; a task hands on one sum for each
of its tiles, and these are summed in the JVM. The matrix is assembled on the driver (dimensions squared doubles, 128 MB at
4,096) and decomposed there. Numbers of vectors are bounded nowhere.

Defined results: rows whose vector is null, empty or has null, NaN or infinite entries, or entries of which 256 times
is no 64-bit number, are left out; if vectors differ in length, those of the length that most distinct vectors have stay (the longer
of two), others are left out; an empty table, or one with no usable vector, gives no rows; repeated vectors count once in the fit and
are returned each; a null id stays null; ids are whole numbers; other columns are not read, whatever their names. Components
of equal eigenvalue are some orthonormal basis of their space. A component without variance (eigenvalue under RANK of the
largest) cannot be whitened: its whitened and explained are null and 0, and it is not in the identity error, which
is null if none is left. A deviation that no 64-bit number holds is null.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import arrow, durable, map_arrow, tidy, with_ids

SCALE = 256
#: Dimensions of a column block, column blocks a side of a square of tiles, rows of a row block.
TILE, SQUARE, ROWS = 32, 32, 4096
#: Share of the largest eigenvalue under which a component has no variance.
RANK = 1e-12
_KINDS = {1: "<i2", 2: "<i4", 3: "<i8"}


def _packed(x: np.ndarray) -> list[bytes]:
    """Rows as bytes: what width they have, then the entries in the least width that holds all of the row, so that equal rows are equal bytes."""
    out: list[bytes] = [b""] * len(x)
    size = np.where(x < 0, ~x, x).max(axis=1)
    kind = np.where(size < 1 << 15, 1, np.where(size < 1 << 31, 2, 3))
    for k, dtype in _KINDS.items():
        rows = np.flatnonzero(kind == k)
        small = x[rows].astype(dtype)
        for at, row in zip(rows.tolist(), small, strict=True):
            out[at] = bytes((k,)) + row.tobytes()
    return out


def _unpacked(rows: list[bytes], dimensions: int) -> np.ndarray:
    out = np.empty((len(rows), dimensions), np.int64)
    for k, dtype in _KINDS.items():
        own = [i for i, row in enumerate(rows) if row[0] == k]
        if own:
            out[own] = np.frombuffer(b"".join([rows[i][1:] for i in own]), dtype).reshape(len(own), dimensions)
    return out


def _dimensions(row: bytes) -> int:
    return (len(row) - 1) // int(_KINDS[row[0]][2])


def quantised(df: DataFrame, id_col: str, vector_col: str, kept: str = "") -> DataFrame:
    """(id, dims, x) of the usable rows; x is packed. No row is moved."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            length = np.where(np.asarray(lists.is_valid()), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
            entries = lists.flatten()
            values = entries.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null as NaN
            with np.errstate(all="ignore"):
                whole = np.floor(values * SCALE)
            good = np.isfinite(whole) & (np.abs(whole) < 2.0**63)
            ends = np.cumsum(length)
            bad = np.concatenate(([0], np.cumsum(~good)))
            usable = (length > 0) & (bad[ends] == bad[ends - length])
            for dims in np.unique(length[usable]).tolist():
                rows = np.flatnonzero(usable & (length == dims))
                x = whole[(ends[rows] - dims)[:, None] + np.arange(dims)].astype(np.int64)
                ids = batch.column(0).take(pa.array(rows)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(rows), dims), pa.int32()), pa.array(_packed(x), pa.binary())], ["id", "dims", "x"])

    return map_arrow(with_ids(df, id_col), [id_col, vector_col], run, "id long, dims int, x binary")


def sums(fit: DataFrame, dimensions: int) -> tuple[int, list[int]]:
    """How many vectors, and their sum in each dimension, exactly."""

    def run(batches):
        n, total = 0, np.zeros(dimensions, object)
        for batch in batches:
            x = _unpacked(batch.column(0).to_pylist(), dimensions)
            if not len(x):
                continue
            n += len(x)
            small = np.abs(x.astype(np.float64)).max(initial=0) * len(x) < 2.0**62
            total = total + (x.sum(axis=0) if small else x.astype(object).sum(axis=0))
        if n:
            digits = [str(v) for v in total.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, dimensions), pa.int32()), pa.array([str(n), *digits])], ["at", "value"])

    rows = arrow(fit.select("x"), run, "at int, value string").groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    found = {r["at"]: int(r["value"]) for r in rows}  # a row a dimension
    return found.get(-1, 0), [found.get(i, 0) for i in range(dimensions)]


def _squares(dimensions: int) -> list[tuple[range, range]]:
    """Pairs of runs of column blocks; together they have every tile once."""
    blocks = -(-dimensions // TILE)
    runs = [range(at, min(at + SQUARE, blocks)) for at in range(0, blocks, SQUARE)]
    return list(combinations_with_replacement(runs, 2))


def covariance(fit: DataFrame, dimensions: int, mean: np.ndarray) -> np.ndarray:
    """The covariance of the fit list (x packed, mean in doubles), assembled from its tiles; divisor not applied."""
    squares = _squares(dimensions)
    wanted = [(square, sorted({*a, *b})) for square, (a, b) in enumerate(squares)]

    def cut(batches):
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            rows = batch.column(0).to_pylist()
            for at in range(0, len(rows), ROWS):
                x = _unpacked(rows[at : at + ROWS], dimensions)
                columns = {j: x[:, j * TILE : (j + 1) * TILE] for j in range(-(-dimensions // TILE))}
                kind = next(k for k in (np.int16, np.int32, np.int64) if not len(x) or np.iinfo(k).min <= x.min() and x.max() <= np.iinfo(k).max)
                sent = {j: c.astype(kind).tobytes() for j, c in columns.items()}
                for square, need in wanted:
                    yield pa.RecordBatch.from_pylist(
                        [{"row_block": block, "square": square, "columns": j, "rows": len(x), "width": np.dtype(kind).itemsize, "data": sent[j]} for j in need], schema=cut_schema
                    )
                block += 1

    cut_schema = pa.schema([("row_block", pa.int64()), ("square", pa.int32()), ("columns", pa.int32()), ("rows", pa.int32()), ("width", pa.int32()), ("data", pa.binary())])

    def multiply(batches):
        tiles: dict[tuple[int, int], np.ndarray] = {}
        key, held = None, {}

        def close():
            if key is None:
                return
            a, b = squares[key[1]]
            for i in a:
                for j in b:
                    if i <= j:
                        product = held[i].T @ held[j]
                        tiles[i, j] = tiles[i, j] + product if (i, j) in tiles else product

        def told():
            for (i, j), tile in tiles.items():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([tile.ravel().tolist()])], ["i", "j", "tile"])
            tiles.clear()

        for batch in batches:
            for row in batch.to_pylist():
                now = row["row_block"], row["square"]
                if now != key:
                    close()
                    if key is not None and now[1] != key[1]:
                        yield from told()  # rows are in order of squares, so the tiles of one alone are held
                    key, held = now, {}
                x = np.frombuffer(row["data"], f"<i{row['width']}").reshape(row["rows"], -1)
                held[row["columns"]] = x - mean[row["columns"] * TILE :][: x.shape[1]]
        close()
        yield from told()

    blocks = arrow(fit.select("x"), cut, "row_block long, square int, columns int, rows int, width int, data binary")
    dealt = blocks.repartition("row_block", "square").sortWithinPartitions("square", "row_block")
    partial = arrow(dealt, multiply, "i int, j int, tile array<double>")
    entries = partial.select("i", "j", F.posexplode("tile").alias("at", "value")).groupBy("i", "j", "at").agg(F.sum("value").alias("value"))
    found = entries.toArrow()  # half of the matrix, the bound stated above
    i, j, at, value = (found.column(c).to_numpy() for c in ("i", "j", "at", "value"))
    width = np.minimum(TILE, dimensions - j * TILE)
    out = np.zeros((dimensions, dimensions))
    out[i * TILE + at // width, j * TILE + at % width] = value
    upper = np.triu(out)
    return upper + np.triu(upper, 1).T


def _gram(fit: DataFrame, dimensions: int, mean: np.ndarray, project: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the fit list's whitened vectors and of their products, measured on the vectors."""
    k = project.shape[1]

    def run(batches):
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = (_unpacked(batch.column(0).to_pylist(), dimensions) - mean) @ project
            total[0] += w.sum(axis=0)
            total[1:] += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], ["at", "value"])

    rows = arrow(fit.select("x"), run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    total = np.zeros((k + 1) * k)
    for r in rows:
        total[r["at"]] = r["value"]
    total = total.reshape(k + 1, k)
    return total[0], total[1:]


@tidy
def whiten(df: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per usable row and component (from 1, by falling eigenvalue): vec_id, component, n (vectors of the fit), deviation
    (exact squared distance of n x to the sum S), whitened, explained (share of the trace), identity_error (largest absolute
    entry of the whitened fit list's measured covariance minus the identity)."""
    rows = quantised(df, id_col, vector_col)
    every = durable(rows.select("dims", "x").distinct())
    common = every.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    dimensions = common["dims"] if common else 1
    fit = every.where(F.col("dims") == dimensions)
    n, total = sums(fit, dimensions)
    k = min(components, dimensions)
    mean = np.array([s / max(n, 1) for s in total])
    matrix = covariance(fit, dimensions, mean) / max(n, 1)
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1][:k].copy(), vectors[:, ::-1][:, :k]
    live = values > RANK * max(values[0], 0.0)
    trace = float(np.trace(matrix))
    project = vectors / np.sqrt(np.where(live, values, 1.0))
    error = None
    if n and live.any():
        first, second = _gram(fit, dimensions, mean, project[:, live])
        error = float(np.abs(second / n - np.outer(first / n, first / n) - np.eye(int(live.sum()))).max())
    explained = [float(v / trace) if ok else 0.0 for v, ok in zip(values, live, strict=True)]
    # In 64 bits where nothing of n x - S can leave them, else in whole numbers of any size.
    sum_ = np.array(total, object)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unpacked(batch.column(1).to_pylist(), dimensions)
            m = len(x)
            if not m:
                continue
            w = (x - mean) @ project
            most = n * int(np.abs(x.astype(np.float64)).max() + 1) + max(map(abs, total))
            if most * most * dimensions < 1 << 62:
                d = n * x - sum_.astype(np.int64)
                deviation = (d * d).sum(axis=1).tolist()
            else:
                d = n * x.astype(object) - sum_
                deviation = [v if v < 1 << 63 else None for v in (d * d).sum(axis=1).tolist()]
            white = pa.array(w.ravel(), mask=np.tile(~live, m))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.arange(m), k)).cast(pa.int64()) if m == 0 else batch.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n), pa.int64()),
                    pa.array([v for v in deviation for _ in range(k)], pa.int64()), white,
                    pa.array(explained * m, pa.float64()), pa.array([error] * (m * k), pa.float64()),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return arrow(rows.where(F.col("dims") == dimensions).select("id", "x"), run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
