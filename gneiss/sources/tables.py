"""Reading Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A table of fewer stored bytes for each core is spread over the cores.
SPREAD_BYTES = 4 << 20


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if it is small.

    A small file is mostly one row group, and that is one task. Moving a few megabytes costs less than leaving
    the other cores idle; a table of many files has tasks enough and is read as it lies. No job runs here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if 64 << 10 < size < cores * SPREAD_BYTES else df
