"""Tables partitioned by a hash of their key: a load reads and writes only the partitions its own keys fall into.

A table lies in folders bucket=0 .. bucket=n-1; its key columns and n are kept in the folder _layout, which readers of the
table pass over. What a load knows of its keys is a list of at most n bucket numbers, which becomes a partition filter, so a
small load into a large table lists and reads a few folders. Keys must hold no nulls. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitloom.operators.ranking import top_per_group
from fitloom.session import stored_once

BUCKET = "bucket"


@dataclass(frozen=True)
class Layout:
    """Key columns and number of buckets of a table."""

    key: tuple[str, ...]
    buckets: int

    def of(self, *values: Column) -> Column:
        """The bucket of a key."""
        return F.pmod(F.xxhash64(*values), F.lit(self.buckets)).cast("int")

    def placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, self.of(*[F.col(k).cast("string") for k in self.key]))


def layout_of(spark: SparkSession, path: str) -> Layout | None:
    """The layout of a stored table; None where there is no table or it is not partitioned by key."""
    try:
        row = spark.read.schema("key array<string>, buckets int").parquet(f"{path}/_layout").first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return Layout(tuple(row["key"]), row["buckets"])


def ensure_layout(spark: SparkSession, path: str, key: Sequence[str], buckets: int) -> Layout:
    """The table's layout, written down if the table is new; an error if it has another one."""
    wanted, found = Layout(tuple(key), buckets), layout_of(spark, path)
    if found is None:
        try:
            old = spark.read.format("parquet").load(path).columns
        except AnalysisException:
            old = []  # absent or empty: both are new
        if old:
            raise ValueError(f"{path} holds a table that is not partitioned by key")
        spark.createDataFrame([(list(wanted.key), buckets)], "key array<string>, buckets int").coalesce(1).write.parquet(f"{path}/_layout")
        return wanted
    if found != wanted:
        raise ValueError(f"{path} is laid out by {found.key} in {found.buckets} buckets")
    return found


def read(spark: SparkSession, path: str, schema: str, buckets: Sequence[int] | None = None) -> DataFrame:
    """The table with its bucket column, of all or only the given buckets; an absent table reads as empty."""
    full = f"{schema}, {BUCKET} int"
    try:
        rows = spark.read.schema(full).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)
    return rows if buckets is None else rows.where(F.col(BUCKET).isin(list(buckets)))


def hit_buckets(placed: DataFrame) -> list[int]:
    """Buckets that hold rows, at most as many as the layout has."""
    return sorted(r[0] for r in placed.select(BUCKET).distinct().collect())


def _write(rows: DataFrame, path: str, mode: str) -> None:
    """One file per bucket, or several where a bucket is large."""
    rows.hint("rebalance", BUCKET).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def _key_schema(rows: DataFrame, key: Sequence[str]) -> str:
    kinds = dict(rows.dtypes)
    return ", ".join(f"`{k}` {kinds[k]}" for k in key)


def new_rows(rows: DataFrame, path: str, layout: Layout) -> DataFrame:
    """Rows (one per key, with their bucket) whose key the table does not hold; of the table only their buckets' keys are read."""
    stored = read(rows.sparkSession, path, _key_schema(rows, layout.key), hit_buckets(rows))
    return rows.join(stored, [BUCKET, *layout.key], "left_anti")


def append(rows: DataFrame, path: str) -> None:
    """Append rows that carry their bucket."""
    _write(rows, path, "append")


def replace(rows: DataFrame, path: str, key: Sequence[str], order: list[Column], buckets: int = 64) -> None:
    """Store rows by key: a key's stored row gives way to the new one, of several new ones the first in order is stored.

    Only buckets that get rows are read and written again. Their new content is stored first, so a write that
    failed half-way is mended by the same call.
    """
    spark = rows.sparkSession
    layout = ensure_layout(spark, path, key, buckets)
    first = stored_once(top_per_group(layout.placed(rows), [BUCKET, *key], order, 1, "_r").drop("_r"))
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    kept = read(spark, path, schema, hit_buckets(first)).join(first.select(BUCKET, *key), [BUCKET, *key], "left_anti")
    _write(stored_once(kept.select(*first.columns).unionByName(first)), path, "overwrite")


def rebucket(spark: SparkSession, path: str, to: str, schema: str, buckets: int) -> None:
    """Copy a table into a new one of another number of buckets."""
    old = layout_of(spark, path)
    if old is None:
        raise ValueError(f"{path} is not partitioned by key")
    layout = ensure_layout(spark, to, old.key, buckets)
    append(layout.placed(read(spark, path, schema).drop(BUCKET)), to)
