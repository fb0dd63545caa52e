"""Chunking documents as they arrive, and re-runs for chosen sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chunkloom.operators.chunking import fixed_size_chunks
from chunkloom.sources.chunk_table import ChunkTable


def backfill(documents: DataFrame, requested: DataFrame, table: ChunkTable) -> None:
    """Chunk the requested sources and replace their rows, in one job.

    Safe to repeat: each run writes the same rows.
    """
    wanted = requested.select(F.col("id").alias("source_id"))
    table.replace_rows(fixed_size_chunks(documents.join(wanted, "source_id", "left_semi")))


def start_chunking(documents: DataFrame, table: ChunkTable, checkpoint: str) -> StreamingQuery:
    """Chunk a stream of documents into the table, once for what is there.

    A batch that is repeated after a failure replaces its own rows, so the
    table holds each source's chunks once.
    """

    def write(batch: DataFrame, _: int) -> None:
        table.replace_rows(fixed_size_chunks(batch))

    return (
        documents.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
