"""Shared plumbing of the training-data operators.

Nothing here knows about any one operator: reading tables, moving Arrow batches
through a Python function, sizing a filter from table metadata and writing an
intermediate table to the folder that every executor can see.

Ids are whole numbers in every operator (any integer type, null allowed); an operator is
refused a column of another type before it begins.
"""

from __future__ import annotations

import atexit
import ctypes
import functools
import sys
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from gneiss.sources.scratch import shared_folder
from gneiss.sources.tables import read_table

#: The white space of the text contracts: space and U+0009 to U+000D.
WHITE = " \t\n\x0b\f\r"
WHITE_CLASS = r"[\x20\x09-\x0D]"

_SCRATCH: dict[str, str] = {}
_LOCAL = threading.local()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def arrow(df: DataFrame, function: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with batches of at most BATCH_BYTES, so that long texts and hidden copies of a
    batch (in the JVM, on the way, in Python) stay small beside an executor's memory."""
    conf = df.sparkSession.conf
    if _bytes(conf.get(_BATCH, "64m")) > BATCH_BYTES:
        conf.set(_BATCH, str(BATCH_BYTES))

    def run(batches):
        yield from function(batches)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system: a worker that waits for its next task should not hold on to it."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def _bytes(value: str) -> int:
    """A Spark size (64m, 67108864b, -1b) in bytes; no bound is as large as can be."""
    units = {"b": 0, "k": 10, "m": 20, "g": 30}
    number = int(value.rstrip("bkmgBKMG"))
    return number << units.get(value[-1].lower(), 0) if number > 0 else 1 << 62


def map_arrow(
    df: DataFrame,
    columns: list[str],
    function: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """Run ``function`` over Arrow batches of just ``columns``.

    See ``arrow`` for the size of batches.
    """
    return arrow(df.select(*columns), function, schema)


def with_ids(df: DataFrame, id_col: str) -> DataFrame:
    """``df``, whose ids are whole numbers."""
    if not isinstance(df.schema[id_col].dataType, IntegralType):
        raise TypeError(f"column {id_col} must hold whole numbers, not {df.schema[id_col].dataType.simpleString()}")
    return df


def free(df: DataFrame, name: str) -> str:
    """``name``, or one like it that no column of ``df`` has."""
    while name in df.columns:
        name = f"_{name}"
    return name


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    """A string column as a list, null as the empty string."""
    return [x if x is not None else "" for x in batch.column(name).to_pylist()]


def slices(texts: list[str], most: int = 8_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of bounded length together, so what is made of one slice fits in memory."""
    begin = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def table_bytes(df: DataFrame) -> int:
    """Bytes of the scanned files as the optimizer's statistics give them; no job runs."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


def _own_folder(spark: SparkSession) -> str:
    """This application's folder in the shared one. It goes with the JVM, also where the session has been stopped before."""
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        path = f"{shared_folder(spark)}/gneiss-{app}-{uuid.uuid4().hex[:8]}"
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
        _SCRATCH[app] = path
    return _SCRATCH[app]


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage in one pass (an eager ``checkpoint()`` computes its rows twice) and survives
    the loss of executors. What the write shuffled goes with it, where Spark can do so, and not when the driver
    next collects its garbage. The files go when a ``tidy`` function that wrote them no longer needs them, at
    the latest when the application ends.
    """
    spark = df.sparkSession
    name = f"gneiss-{uuid.uuid4().hex}"
    path = f"{_own_folder(spark)}/{name}"
    _written()[name] = remove = functools.partial(_remove, spark, path)
    atexit.register(remove)
    kept = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if kept is None else spark.conf.set(_CLEANUP, kept)
    return spark.read.schema(df.schema).parquet(path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tidy(function: Callable) -> Callable:
    """A function that removes the ``durable`` tables it wrote, but those that the frames it returns read."""

    @functools.wraps(function)
    def run(*args, **kwargs):
        before, used = set(_written()), set()
        try:
            result = function(*args, **kwargs)
            for frame in result if isinstance(result, tuple) else (result,):
                if isinstance(frame, DataFrame):
                    used |= _read_by(frame)
            return result
        finally:
            for name in [n for n in _written() if n not in before and n not in used]:
                remove = _written().pop(name)
                atexit.unregister(remove)
                remove()

    return run


def _written() -> dict[str, Callable[[], None]]:
    """Names of this thread's tables, and what removes each."""
    if not hasattr(_LOCAL, "tables"):
        _LOCAL.tables = {}
    return _LOCAL.tables


def _read_by(df: DataFrame) -> set[str]:
    """Names of the ``durable`` tables that the plan of ``df`` reads."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    plan = " ".join(leaf.relation().location().rootPaths().mkString(" ") for leaf in map(leaves.apply, range(leaves.size())) if leaf.nodeName().startswith("LogicalRelation"))
    return {name for name in _written() if name in plan}


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has gone already; the cluster's own cleaning takes over
        pass


def spaced(column):
    """Each run of the contracts' white space as one space; null as the empty string."""
    return F.regexp_replace(F.coalesce(column, F.lit("")), WHITE_CLASS + "+", " ")
