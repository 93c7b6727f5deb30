"""Resume files as a stream: each file is read and parsed once, in the run that first finds it."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from fitloom.functions.lexicons import ProfileTerms
from fitloom.plans.profiles import parse_profiles
from fitloom.session import listing_session
from fitloom.sources import files

PROFILES, QUARANTINE, BATCH = "profiles", "quarantine", "batch_id"


def ingest_resumes(spark: SparkSession, landing: str, path: str, checkpoint: str, terms: ProfileTerms = ProfileTerms(),
                   max_files: int | None = None) -> StreamingQuery:
    """Parse the files that landed since the last run into path/profiles and path/quarantine, then stop.

    Run again with the same checkpoint to go on. A file is known by its path: a changed resume lands under a new name.
    Each micro-batch owns one folder per table, which a repeated batch overwrites, so a lost driver or executor leaves
    every file stored once. max_files bounds the files of each format in a micro-batch; the default takes all
    there are. The landing folder must exist; it and the others must be shared by all executors.
    """
    session = listing_session(spark)

    def reader():
        stream = session.readStream
        return stream if max_files is None else stream.option("maxFilesPerTrigger", max_files)

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # two tables from one reading
        for name, rows in ((PROFILES, parse_profiles(files.as_resumes(batch), terms)), (QUARANTINE, files.as_quarantine(batch))):
            rows.write.mode("overwrite").parquet(f"{path}/{name}/{BATCH}={batch_id}")
        batch.unpersist()

    return (
        files.landed_files(reader, landing).writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _read(spark: SparkSession, folder: str, empty: DataFrame) -> DataFrame:
    try:
        return spark.read.schema(T.StructType([*empty.schema.fields, T.StructField(BATCH, T.LongType())])).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty.withColumn(BATCH, F.lit(None).cast("long"))


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profiles of all runs with the batch that stored them; none yet reads as empty."""
    texts = spark.createDataFrame([], "resume_id string, raw_text string, source_file string")
    return _read(spark, f"{path}/{PROFILES}", parse_profiles(texts))


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    """Files that gave no profile, with the reason and the batch."""
    return _read(spark, f"{path}/{QUARANTINE}", spark.createDataFrame([], "source_file string, reason string"))
