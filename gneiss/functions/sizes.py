"""Small tables, known to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame

MOST_ROWS, MOST_BYTES = 100_000, 8 << 20


def if_small(df: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> DataFrame | None:
    """``df`` as a local table, if it has at most so many rows and bytes; its plan runs once, here.

    Spark knows the size of a local table and sends it to the executors of its own accord.
    """
    rows = df.limit(most_rows + 1).toArrow()
    if rows.num_rows > most_rows or rows.nbytes > most_bytes:
        return None
    return df.sparkSession.createDataFrame(rows, df.schema)
