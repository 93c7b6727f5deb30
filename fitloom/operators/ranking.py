"""Running numbers and top-k without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitloom.functions.text import stars
from fitloom.session import stored_once

_POSITION_BITS = 33


def row_index(df: DataFrame, order: list[Column], name: str = "row_index") -> DataFrame:
    """Number all rows 1..n in the given total order.

    Rows are range-partitioned and sorted, each partition is numbered on its own, and the sizes of
    the partitions before it are added. The sorted rows are stored once, so the numbers stay valid
    when a task is run again. End the order with a unique column: then even a value held by most
    rows is split over many partitions.
    """
    placed = stored_once(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    block = F.shiftright("_at", _POSITION_BITS)
    sizes = placed.groupBy(block.alias("_block")).agg(F.count("*").alias("_n"))
    # One row per range partition: as small as the number of shuffle partitions.
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    return (
        placed.withColumn("_block", block)
        .join(F.broadcast(offsets), "_block")
        .withColumn(name, F.col("_before") + inside + 1)
        .drop("_block", "_before", "_at")
    )


def join_null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that lets nulls meet; the key columns come from the left."""
    named = right.select(*[F.col(c).alias(f"_on_{c}") for c in on], *[c for c in right.columns if c not in on])
    meets = [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on]
    return left.join(named, meets, how).drop(*[f"_on_{c}" for c in on])


def score_breaks(scored: DataFrame, order: list[str], group: list[str] | None = None) -> DataFrame:
    """Ranked list with a running number and a header row mark wherever the score changes.

    order breaks ties within a score and must end with a unique column.
    """
    group = group or []
    keys: list[Column] = [F.col(g).asc() for g in group]
    numbered = row_index(scored, [*keys, F.desc("match_score"), *[F.col(c).asc() for c in order]], "_i")
    starts = (
        numbered.groupBy(*group, "match_score")
        .agg(F.min("_i").alias("_start"))
    )
    if group:
        firsts = starts.groupBy(*group).agg(F.min("_start").alias("_first"))
        starts = join_null_safe(starts, firsts, group)
    else:
        starts = starts.withColumn("_first", F.lit(1))
    return (
        join_null_safe(numbered, starts, [*group, "match_score"])
        .withColumn("position", F.col("_i") - F.col("_first") + 1)
        .withColumn("is_break", F.col("_i") == F.col("_start"))
        .withColumn("header", F.when(F.col("is_break"), stars(F.col("match_score"))))
        .drop("_i", "_start", "_first")
    )


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int,
                  name: str = "rank") -> DataFrame:
    """First k rows per group; each task drops all but k rows per group before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def cap_before(df: DataFrame, group: list[str], order: list[Column], k: int, keep: Column) -> DataFrame:
    """Input cap: the first k rows per group are looked at, those that pass keep stay."""
    return top_per_group(df, group, order, k, "_r").where(keep).drop("_r")


def cap_after(df: DataFrame, group: list[str], order: list[Column], k: int, keep: Column) -> DataFrame:
    """Output cap: the first k rows per group that pass keep."""
    return top_per_group(df.where(keep), group, order, k, "_r").drop("_r")


def open_units(df: DataFrame, group: list[str], unit: str, k: int) -> DataFrame:
    """Units (in unit order) reached before k rows were counted in their group.

    The cap is tested after each unit, so the last unit may overshoot. A unit that counts has at
    least one row, so no more than the first k units of a group can be reached.
    """
    sizes = df.groupBy(*group, unit).agg(F.count("*").alias("_n"))
    first = top_per_group(sizes, group, [F.col(unit).asc()], k, "_r")
    before = Window.partitionBy(*group).orderBy(unit).rowsBetween(Window.unboundedPreceding, -1)
    return (
        first.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .where(F.col("_before") < k)
        .select(*group, unit)
    )


def cap_at_boundary(df: DataFrame, group: list[str], unit: str, k: int) -> DataFrame:
    """Group-boundary cap: whole units until k rows are reached."""
    return join_null_safe(df, open_units(df, group, unit, k), [*group, unit], "left_semi")
