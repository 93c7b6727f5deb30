"""Incremental ingest: micro-batches go through the keyed load into the same jobs table that batch loads append to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from fitloom.operators import store


def ingest(stream: DataFrame, path: str, checkpoint: str, order: list[Column], as_of: Column,
           created_at: Column, rejects: str | None = None, buckets: int | None = None) -> StreamingQuery:
    """Append the postings of each micro-batch whose link is not stored yet for their resume, then stop.

    Run again with the same checkpoint to go on. Keys are looked up in the table itself, so the stream
    holds no state. A batch that is run again after a lost driver finds the rows it had written and adds
    the others. Rows that cannot be stored go with their reason to rejects, one folder per batch, which
    a repeated batch overwrites. With buckets the table is partitioned by key, and a micro-batch reads only the
    partitions of its own keys. All folders must be shared by all executors.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if rejects is not None:
            store.quarantine(batch).write.mode("overwrite").parquet(f"{rejects}/batch_id={batch_id}")
        store.append_jobs(spark, path, batch, order, as_of, created_at, buckets)

    return (
        stream.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
