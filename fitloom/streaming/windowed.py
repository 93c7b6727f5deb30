"""Ingest without look-ups: repeats are known from state that event time bounds, not from the jobs table.

The other form, streaming.ingest, holds no state and reads the keys of the table's own partitions for each micro-batch. This
one never reads a stored row; its state holds a key from its first event for the time `delay`, and the watermark, the
latest event time seen less `delay`, decides when a key is forgotten and which rows come too late.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fitloom import schemas
from fitloom.operators import store

BATCH = "batch_id"


def ingest_within(stream: DataFrame, path: str, checkpoint: str, event_time: str, delay: str, as_of: Column,
                  created_at: Column) -> StreamingQuery:
    """Store the first row per resume and link among rows less than `delay` of event time apart, then stop.

    Run again with the same checkpoint to go on. Rows at or before the watermark, as it stood when the
    micro-batch before had ended, are late and dropped; Spark counts them in the query's progress. Of equal keys in one
    micro-batch any one is stored. Rows without company, title or event time, which could not be stored or placed in time, are left
    out before the state. Each micro-batch owns a folder that a repeated one overwrites, and state is
    kept in the checkpoint, so lost executors and drivers leave every row stored once. All folders must be shared.
    """
    def load(batch: DataFrame, batch_id: int) -> None:
        store.as_jobs(batch, as_of, created_at).write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    storable = store.by_resume(stream).withColumn("link", F.coalesce("link", F.lit(""))).where(
        store.bad_row_reason().isNull() & F.col(event_time).isNotNull())
    return (
        storable.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(store.JOB_KEY))
        .writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all micro-batches; none yet reads as empty."""
    try:
        return spark.read.schema(schemas.JOBS).parquet(path).select(*schemas.JOBS.names)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.JOBS)
