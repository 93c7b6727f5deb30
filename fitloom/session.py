"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folders of the innermost passing block.
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def local_session(cores: str | int = "*", app: str = "fitloom") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    parts = "8" if cores == "*" else str(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", parts)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("FITLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in spark.checkpoint.dir.

    Only a local master may fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="fitloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored_once(df: DataFrame, codec: str | None = None, parts: tuple[str, ...] = (), stays: bool = False) -> DataFrame:
    """Write df to a table in the shared folder and go on from there.

    A written table is computed once and read by column; a lost executor re-reads it. All tables
    of an application share one folder named after it, to be removed when it has ended. Inside a passing block
    a table goes with the block, unless it stays. parts: columns by which the table is cut into folders.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/fitloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    passing_folders = _PASSING.get()
    if passing_folders is not None and not stays:
        passing_folders.append(folder)
    writer = df.write.partitionBy(*parts) if parts else df.write
    (writer if codec is None else writer.option("compression", codec)).parquet(folder)
    if passing_folders is not None:
        _drop_shuffles(spark)
    return spark.read.schema(df.schema).parquet(folder)


def _drop_shuffles(spark: SparkSession) -> None:
    """Shuffle files of plans that have ended go when the driver collects its garbage; it may not do so for long on its own."""
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder in whatever store it lies."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside go at the end of the block; nothing that is used after it may read them."""
    folders: list[str] = []
    token = _PASSING.set(folders)
    try:
        yield
    finally:
        _PASSING.reset(token)
        for folder in folders:
            remove(spark, folder)


def spread(df: DataFrame) -> DataFrame:
    """Give a small input at least one partition per core.

    A table with more input splits than cores is left alone, so large scans are never shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def listing_session(spark: SparkSession) -> SparkSession:
    """A session with the settings of spark whose listings of many folders take a few tasks a core, not one a folder."""
    session = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if session.conf.isModifiable(key):
            session.conf.set(key, value)
    tasks = int(spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism", "10000"))
    session.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(min(tasks, 4 * spark.sparkContext.defaultParallelism)))
    return session
