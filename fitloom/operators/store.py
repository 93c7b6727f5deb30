"""The keyed jobs table, its status log and its statistics, and the tabular tracker."""

from __future__ import annotations

from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from fitloom import schemas
from fitloom.functions.lexicons import JOB_STATUSES, SHEET_STATUSES
from fitloom.operators import dedup, keyed
from fitloom.session import stored_once

DEFAULT_STATUS = "Not Applied"


@dataclass(frozen=True)
class LoadCounts:
    incoming: int
    inserted: int
    quarantined: int

    @property
    def skipped(self) -> int:
        return self.incoming - self.inserted - self.quarantined


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """The stored table, however it is laid out; an absent one reads as empty."""
    try:
        return spark.read.schema(schemas.JOBS).parquet(path).select(*schemas.JOBS.names)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.JOBS)


def bad_row_reason() -> Column:
    """Why a row cannot be stored, or null. The table requires company and title."""
    return F.when(F.col("company").isNull(), "company is null").when(
        F.col("title").isNull(), "title is null"
    )


def quarantine(rows: DataFrame) -> DataFrame:
    return rows.withColumn("reason", bad_row_reason()).where("reason is not null")


def by_resume(rows: DataFrame) -> DataFrame:
    """Rows with a resume_id text; blank where the resume is null or the rows know none (a store of one resume)."""
    known = F.col("resume_id").cast("string") if "resume_id" in rows.columns else F.lit(None).cast("string")
    return rows.withColumn("resume_id", F.coalesce(known, F.lit("")))


def as_jobs(rows: DataFrame, as_of: Column, created_at: Column) -> DataFrame:
    """Postings with a score as rows of the jobs table, missing fields set to their defaults."""
    return by_resume(rows).select(
        "resume_id",
        F.coalesce("date_posted", F.date_format(as_of, "yyyy-MM-dd")).alias("date_found"),
        "company",
        "title",
        F.coalesce("location", F.lit("")).alias("location"),
        F.coalesce("type", F.lit("Internship")).alias("job_type"),
        F.coalesce("match_score", F.lit(0)).cast("int").alias("match_score"),
        F.lit(DEFAULT_STATUS).alias("application_status"),
        F.coalesce("link", F.lit("")).alias("link"),
        F.coalesce("source", F.lit("")).alias("source"),
        "salary",
        F.coalesce("description", F.lit("")).alias("description"),
        created_at.cast("timestamp").alias("created_at"),
    )


def _observed(seen: Observation, name: str) -> int:
    """An observed count; 0 where Spark saw that there are no rows and left the counting out."""
    try:
        return seen.get.get(name) or 0
    except Py4JJavaError as e:
        if e.java_exception.getClass().getName() != "java.lang.AssertionError":
            raise
        return 0


#: What a row of the jobs table is known by.
JOB_KEY = ("resume_id", "link")


def append_jobs(spark: SparkSession, path: str, rows: DataFrame, order: list[Column],
                as_of: Column, created_at: Column, buckets: int | None = None) -> LoadCounts:
    """Append the rows whose link is not stored yet for their resume, in one write.

    The counts are observed while that write runs; nothing is computed twice. A table that was begun with a number of
    buckets is partitioned by its key, and each load reads the keys of those partitions alone that its own
    keys fall into; the number is needed for the first load only.
    """
    layout = keyed.layout_of(spark, path)
    if buckets is not None:
        layout = keyed.ensure_layout(spark, path, JOB_KEY, buckets)
    seen, stored = Observation(), Observation()
    checked = by_resume(rows).observe(
        seen,
        F.count(F.lit(1)).alias("n"),
        F.count_if(bad_row_reason().isNotNull()).alias("bad"),
    ).where(bad_row_reason().isNull())
    if layout is None:
        new = dedup.select_new(checked, by_resume(read_jobs(spark, path)), order, group=["resume_id"])
        as_jobs(new, as_of, created_at).observe(stored, F.count(F.lit(1)).alias("n")).write.mode(
            "append"
        ).parquet(path)
    else:
        named = checked.withColumn("link", F.coalesce("link", F.lit("")))
        first = dedup.first_per_key(named, "link", order, ["resume_id"], "one_blank")
        # Stored once: the buckets are looked up before the rows are joined.
        placed = stored_once(layout.placed(as_jobs(first, as_of, created_at)))
        keyed.append(keyed.new_rows(placed, path, layout).observe(stored, F.count(F.lit(1)).alias("n")), path)
    return LoadCounts(_observed(seen, "n"), _observed(stored, "n"), _observed(seen, "bad"))


def ordered_jobs(jobs: DataFrame, tiebreak: list[str]) -> DataFrame:
    return jobs.orderBy(F.desc("match_score"), F.desc("date_found"), *tiebreak)


def valid_status(status: Column, allowed=JOB_STATUSES) -> Column:
    return status.isin(list(allowed))


def checked_status(status: Column, allowed=JOB_STATUSES) -> Column:
    """The status, or a failed job naming the allowed ones."""
    return F.when(valid_status(status, allowed), status).otherwise(
        F.raise_error(F.concat(F.lit("Invalid status, allowed: " + ", ".join(allowed) + "; got "), status))
    )


def record_status(updates: DataFrame, path: str, strict: bool = True) -> None:
    """Append (resume_id, link, status, ts) updates to the status log."""
    if strict:
        updates = updates.withColumn("status", checked_status(F.col("status")))
    else:
        updates = updates.where(valid_status(F.col("status")))
    by_resume(updates).select("resume_id", "link", "status", "ts").write.mode("append").parquet(path)


def latest_per_key(log: DataFrame, key: list[str], value: str, order: list[str]) -> DataFrame:
    """Last value per key; tasks keep one row per key before the shuffle."""
    return log.groupBy(*key).agg(F.max_by(value, F.struct(*order)).alias(value))


def latest_status(jobs: DataFrame, log: DataFrame) -> DataFrame:
    """Jobs with the last status recorded for their resume and link; all rows of that key change."""
    key = ["resume_id", "link"]
    last = latest_per_key(by_resume(log), key, "status", ["ts", "status"])
    columns = [
        F.coalesce("status", "application_status").alias(c) if c == "application_status" else F.col(c)
        for c in jobs.columns
    ]
    return by_resume(jobs).join(last, key, "left").select(*columns)


def status_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("application_status").agg(F.count("*").alias("n"))


def stats(jobs: DataFrame) -> DataFrame:
    """One row: total, by_status, avg_score over positive scores (0 when there is none)."""
    positive = F.col("match_score") > 0
    per_status = jobs.groupBy("application_status").agg(
        F.count("*").alias("n"),
        F.sum(F.when(positive, F.col("match_score"))).alias("total_score"),
        F.count_if(positive).alias("n_positive"),
    )
    # One row per status from here on.
    average = F.sum("total_score") / F.nullif(F.sum("n_positive"), F.lit(0))
    return per_status.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.map_from_entries(
            F.sort_array(F.collect_list(F.struct("application_status", "n")))
        ).alias("by_status"),
        F.coalesce(F.bround(average, 1), F.lit(0.0)).alias("avg_score"),
    )


def sheet_rows(rows: DataFrame, sheet: DataFrame, as_of: Column) -> DataFrame:
    """New tracker rows: a resume's links in the sheet are left out, blank and repeated links stay.

    Rows of several resumes name theirs in a first column, Resume.
    """
    group = ["resume_id"]
    resume = F.col("Resume") if "Resume" in sheet.columns else F.lit("")
    known = by_resume(sheet.select(resume.alias("resume_id"), F.col("`Job Link`").alias("link")))
    new = dedup.select_new(by_resume(rows), known, [], blank="anti_only", group=group)
    named = [F.col("resume_id").alias("Resume")] if "resume_id" in rows.columns else []
    return new.select(
        *named,
        F.coalesce("date_posted", F.date_format(as_of, "yyyy-MM-dd")).alias("Date Found"),
        F.coalesce("company", F.lit("Unknown")).alias("Company"),
        F.coalesce("title", F.lit("Unknown")).alias("Title"),
        F.coalesce("location", F.lit("")).alias("Location"),
        F.coalesce("type", F.lit("Internship")).alias("Type"),
        F.coalesce("match_score", F.lit(0)).cast("int").alias("Match Score"),
        F.col("link").alias("Job Link"),
        F.coalesce("source", F.lit("")).alias("Source"),
        F.lit("").alias("Status"),
    )


_SHEET_SCHEMA = ", ".join(
    f"`{c}` {'int' if c == 'Match Score' else 'string'}" for c in ("Resume", *schemas.SHEET_COLUMNS)
)


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """The stored tracker; an absent one reads as empty."""
    try:
        return spark.read.schema(_SHEET_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _SHEET_SCHEMA)


def append_sheet(spark: SparkSession, path: str, rows: DataFrame, as_of: Column) -> int:
    """Append new tracker rows and return how many were added."""
    added = Observation()
    sheet_rows(by_resume(rows), read_sheet(spark, path), as_of).observe(
        added, F.count(F.lit(1)).alias("n")
    ).write.mode("append").parquet(path)
    return _observed(added, "n")


def export_sheet(sheet: DataFrame, path: str) -> None:
    """Write tracker rows as CSV files with a header, as spreadsheets read them."""
    sheet.write.option("header", True).option("escape", '"').csv(path)


def off_domain_statuses(sheet: DataFrame, allowed=SHEET_STATUSES) -> DataFrame:
    """Tracker rows whose filled-in status is not one of the offered values."""
    return sheet.where((F.col("Status") != "") & ~valid_status(F.col("Status"), allowed))
