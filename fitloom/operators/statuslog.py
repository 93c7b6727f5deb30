"""A status log by day of arrival, and snapshots of it: the last status of a key without reading the whole log.

A snapshot of a day holds, per key, the last status among all updates that arrived up to that day. What is current
is the newest snapshot and the days after it. Days are days of arrival, so an update that comes late, with an old time
of its own, lies in a day that is still to be read; which update is the last is decided by its own time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitloom import schemas
from fitloom.functions.lexicons import JOB_STATUSES
from fitloom.operators import store

DAY = "day"
_COLUMNS = tuple(schemas.STATUS_LOG.names)
_SCHEMA = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.STATUS_LOG)


def record(updates: DataFrame, path: str, day: Column, allowed=JOB_STATUSES, strict: bool = True) -> None:
    """Append (resume_id, link, status, ts) updates that arrive on a day; unknown statuses fail the write, or are left out."""
    if strict:
        updates = updates.withColumn("status", store.checked_status(F.col("status"), allowed))
    else:
        updates = updates.where(store.valid_status(F.col("status"), allowed))
    store.by_resume(updates).select(*_COLUMNS, day.cast("date").alias(DAY)).hint("rebalance", DAY).write.mode("append").partitionBy(DAY).parquet(path)


def _read(spark: SparkSession, path: str) -> DataFrame:
    """All rows with their day; an absent folder reads as empty."""
    try:
        return spark.read.schema(f"{_SCHEMA}, {DAY} date").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{_SCHEMA}, {DAY} date")


def newest_snapshot(spark: SparkSession, snapshots: str, upto: Column | None = None) -> str | None:
    """The day of the newest snapshot, or of the newest one up to a day; folder names alone are read."""
    days = _read(spark, snapshots).select(DAY)
    found = (days if upto is None else days.where(F.col(DAY) <= upto)).agg(F.max(DAY)).first()[0]
    return None if found is None else found.isoformat()


def _last(rows: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("status", "ts"), F.struct("ts", "status"))
    return rows.groupBy("resume_id", "link").agg(last.alias("u")).select("resume_id", "link", "u.status", "u.ts")


def current(spark: SparkSession, path: str, snapshots: str, upto: Column | None = None) -> DataFrame:
    """(resume_id, link, status, ts) per key, from the newest snapshot and the days after it, both pruned by folder."""
    log = _read(spark, path)
    if upto is not None:
        log = log.where(F.col(DAY) <= upto)
    since = newest_snapshot(spark, snapshots, upto)
    if since is None:
        return _last(log.select(*_COLUMNS))
    base = _read(spark, snapshots).where(F.col(DAY) == F.lit(since).cast("date"))
    return _last(base.unionByName(log.where(F.col(DAY) > F.lit(since).cast("date"))).select(*_COLUMNS))


def compact(spark: SparkSession, path: str, snapshots: str, day: str) -> None:
    """Write the snapshot of a day from the newest one up to it and the days between; written again, it is replaced.

    Days up to it must be complete: updates that arrive later belong to later days.
    """
    upto = F.lit(day).cast("date")
    before = F.date_sub(upto, 1)  # the day's own snapshot is made anew
    rows = current(spark, path, snapshots, before).unionByName(_read(spark, path).where(F.col(DAY) == upto).select(*_COLUMNS))
    _last(rows).write.mode("overwrite").parquet(f"{snapshots}/{DAY}={day}")


def latest(jobs: DataFrame, path: str, snapshots: str) -> DataFrame:
    """Jobs with the last status recorded for their resume and link."""
    return store.latest_status(jobs, current(jobs.sparkSession, path, snapshots))
