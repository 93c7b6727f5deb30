"""Jobs clustered by score: sorted runs of blocks, whose ranges tell which blocks a threshold or a page needs.

The order is the one jobs are listed in: highest score, then latest date, then resume, link and the other identifying columns.
Rows added together are a run. They are range-partitioned on that order, so one score held by most rows still spreads over many
blocks, and each block is written sorted as a folder run=name/block=k. The folder _ranges keeps first and last (score,
date) and the count of every block: a few numbers per rows_per_block rows. Readers choose blocks from it and list, open and sort
no others. compact merges all runs into one. What a failed addition left behind is in no range, so readers pass over it.
One writer at a time.
"""

from __future__ import annotations

import math
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitloom import schemas
from fitloom.session import stored_once

RUN, BLOCK = "run", "block"
_STORED = T.StructType([*schemas.JOBS.fields, T.StructField(RUN, T.StringType()), T.StructField(BLOCK, T.IntegerType())])
_RANGES = "run string, block int, first struct<score:int,date:string>, last struct<score:int,date:string>, n long"


def job_order() -> list[Column]:
    ties = ("resume_id", "link", "company", "title", "source", "created_at")
    return [F.desc("match_score"), F.desc("date_found"), *[F.asc(c) for c in ties]]


def ranges(spark: SparkSession, path: str) -> list[Row]:
    """(run, block, first, last, n) of the table's blocks by number; none for an absent table."""
    try:
        return spark.read.schema(_RANGES).parquet(f"{path}/_ranges").orderBy(BLOCK).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def _blocks(spark: SparkSession, path: str, chosen: list[Row]) -> DataFrame:
    """Rows of the chosen blocks; run and block become partition filters."""
    if not chosen:
        return spark.createDataFrame([], schemas.JOBS)
    runs, blocks = sorted({r[RUN] for r in chosen}), [r[BLOCK] for r in chosen]
    rows = spark.read.schema(_STORED).parquet(path).where(F.col(RUN).isin(runs) & F.col(BLOCK).isin(blocks))
    return rows.select(*schemas.JOBS.names)


def add(jobs: DataFrame, path: str, rows_per_block: int = 1_000_000) -> int:
    """Add rows of the jobs table, their score and date filled, as one sorted run; the number of blocks asked for."""
    spark = jobs.sparkSession
    rows = stored_once(jobs.select(*schemas.JOBS.names))
    n = rows.count()
    if n == 0:
        return 0
    run, size = uuid.uuid4().hex, math.ceil(n / rows_per_block)
    start = max((r[BLOCK] + 1 for r in ranges(spark, path)), default=0)
    (
        rows.repartitionByRange(size, *job_order())
        .withColumn(BLOCK, F.spark_partition_id() + start)
        .sortWithinPartitions(BLOCK, *job_order())
        .write.partitionBy(BLOCK).parquet(f"{path}/{RUN}={run}")
    )
    at = F.struct(F.col("match_score").alias("score"), F.col("date_found").alias("date"))
    stored = spark.read.schema(_STORED).parquet(path).where(F.col(RUN) == run)
    made = stored.groupBy(RUN, BLOCK).agg(F.max(at).alias("first"), F.min(at).alias("last"), F.count("*").alias("n"))
    made.coalesce(1).write.mode("append").parquet(f"{path}/_ranges")
    return size


def read(spark: SparkSession, path: str) -> DataFrame:
    """All rows, in no order."""
    return _blocks(spark, path, ranges(spark, path))


def at_least(spark: SparkSession, path: str, score: int) -> DataFrame:
    """Rows of a score or more, from the blocks that can hold one."""
    blocks = [r for r in ranges(spark, path) if r["first"]["score"] >= score]
    return _blocks(spark, path, blocks).where(F.col("match_score") >= score)


def page_blocks(listed: list[Row], start: int, n: int) -> tuple[list[Row], int]:
    """(blocks that can hold the places start .. start + n - 1, number of rows in those left out before them)."""
    def key(at) -> tuple[int, str]:
        return at["score"], at["date"]

    # A block all of whose rows have their place before start: the blocks that reach as high hold no more than start rows.
    high = sorted(listed, key=lambda r: key(r["first"]), reverse=True)
    before, at, total = set(), 0, 0
    for r in sorted(listed, key=lambda r: key(r["last"]), reverse=True):
        while at < len(high) and key(high[at]["first"]) >= key(r["last"]):
            total += high[at]["n"]
            at += 1
        if total > start:
            break
        before.add(r[BLOCK])
    # A block is behind the page if the blocks that end above its first row fill start + n places.
    low = sorted(listed, key=lambda r: key(r["last"]), reverse=True)
    chosen, at, full = [], 0, 0
    for r in high:
        while at < len(low) and key(low[at]["last"]) > key(r["first"]):
            full += low[at]["n"]
            at += 1
        if full >= start + n:
            break
        if r[BLOCK] not in before:
            chosen.append(r)
    return chosen, sum(r["n"] for r in listed if r[BLOCK] in before)


def page(spark: SparkSession, path: str, start: int, n: int) -> DataFrame:
    """The rows at places start .. start + n - 1 (from 0) of the listing, in its order."""
    blocks, skipped = page_blocks(ranges(spark, path), start, n)
    return _blocks(spark, path, blocks).orderBy(*job_order()).offset(start - skipped).limit(n)


def compact(spark: SparkSession, path: str, to: str, rows_per_block: int = 1_000_000) -> int:
    """Write all runs as one into a new table; the number of its blocks."""
    return add(read(spark, path), to, rows_per_block)
