"""Filings as a stream: files that arrive are chunked and upserted.

Chunk ids are stable, so a batch that comes again changes nothing and at-least-once delivery is enough.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gneiss.operators.chunking import chunk_filings
from gneiss.sources.store import Store

ARRIVING = (
    "ticker string, form string, filing_date string, period_of_report string, accession_number string, "
    "source_url string, document_name string, html string"
)


def stream_filings(spark: SparkSession, folder: str, store: Store, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Start a query over JSON files of filings with their HTML; it takes what is there, then stops."""
    arriving = spark.readStream.schema(ARRIVING).option("maxFilesPerTrigger", files_per_batch).json(folder)

    def add(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            chunks = chunk_filings(batch.dropDuplicates(["source_url"]))
            store.upsert(chunks.withColumn("seq", F.struct("source_url", "block_seq")).drop("block_seq"))

    return arriving.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
