"""Landed resume files as a text table; what cannot be read goes to a quarantine table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from fitloom.functions import markup
from fitloom.functions.text import strip

TEXT_SUFFIX, OFFICE_SUFFIX = ".txt", ".docx"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


#: Schema of the binaryFile source, which a stream must be given.
_BINARY = "path string, modificationTime timestamp, length long, content binary"


def _landed(reader: DataFrameReader | DataStreamReader, pattern: str):
    return reader.option("pathGlobFilter", pattern).option("recursiveFileLookup", True)


def _binary(reader: DataFrameReader | DataStreamReader, folder: str, pattern: str) -> DataFrame:
    return _landed(reader.format("binaryFile").schema(_BINARY), pattern).load(folder)


def text_files(reader: DataFrameReader | DataStreamReader, folder: str) -> DataFrame:
    return _landed(reader, "*.[tT][xX][tT]").text(folder, wholetext=True).select(
        F.col("_metadata.file_path").alias("source_file"), strip(F.col("value")).alias("raw_text")
    )


def office_files(reader: DataFrameReader | DataStreamReader, folder: str) -> DataFrame:
    return _binary(reader, folder, "*.[dD][oO][cC][xX]").select(
        F.col("path").alias("source_file"), markup.docx_text("content").alias("raw_text")
    )


def other_files(reader: DataFrameReader | DataStreamReader, folder: str) -> DataFrame:
    """Names of the files of no known format: the content column is never asked for, so none is opened."""
    return (
        _binary(reader, folder, "*")
        .select(F.col("path").alias("source_file"))
        .where(~suffix(F.col("source_file")).isin(TEXT_SUFFIX, OFFICE_SUFFIX))
    )


def file_reason() -> Column:
    """Why a file gives no resume, or null."""
    return F.when(
        ~suffix(F.col("source_file")).isin(TEXT_SUFFIX, OFFICE_SUFFIX),
        F.concat(F.lit("unsupported format: "), suffix(F.col("source_file"))),
    ).when(F.coalesce("raw_text", F.lit("")) == "", "no text found")


def landed_files(new_reader: Callable[[], DataFrameReader | DataStreamReader], folder: str) -> DataFrame:
    """(source_file, raw_text, reason) of every file of a folder; new_reader gives a reader of a batch or of a stream."""
    names = other_files(new_reader(), folder).withColumn("raw_text", F.lit(None).cast("string"))
    texts = text_files(new_reader(), folder).unionByName(office_files(new_reader(), folder))
    return texts.unionByName(names).withColumn("reason", file_reason())


def as_resumes(files: DataFrame) -> DataFrame:
    return files.where("reason IS NULL").select(F.sha2("source_file", 256).alias("resume_id"), "raw_text", "source_file")


def as_quarantine(files: DataFrame) -> DataFrame:
    return files.where("reason IS NOT NULL").select("source_file", "reason")


def read_resumes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(resumes, quarantine) of a folder of files.

    resumes: resume_id, raw_text, source_file. quarantine: source_file, reason.
    """
    files = landed_files(lambda: spark.read, folder)
    return as_resumes(files), as_quarantine(files)
