"""Shared pieces of the training-data operators: tables, row keys, checked broadcasts, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitloom.session import shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A side of at most so many rows of a few numbers or one word may be broadcast.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write df to a table in the shared folder and read it back: computed once, safe when executors are lost."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/llm-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def ascii_lower(word: Column) -> Column:
    """Lower-case A-Z only; a word of plain bytes takes the quick way, which does the same there."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def row_keys(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """_d and _k tell rows apart without nulls: the id and a 64-bit hash of the text.

    Rows equal in both are the same document; a null id equals no other id as long as texts differ.
    """
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("_d"),
            F.xxhash64(F.col(id_col).isNull(), F.col(text_col)).alias("_k")]


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if df was counted and holds at most so many rows; else Spark chooses the join."""
    return F.broadcast(df) if df.count() <= rows else df


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b) as (node, root), root the smallest node; other nodes are absent.

    Alternates large-star and small-star steps. Each step is a grouped minimum and a join whose
    skewed side Spark may split; steps end when the edges stay the same. Nothing is gathered.
    """
    cur = stored(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m")))
        large = stored(
            both.where("v > u").join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.where("m != u").select("u", F.col("m").alias("v"))).distinct()
        )
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")))
        cur = stored(
            large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        )
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
