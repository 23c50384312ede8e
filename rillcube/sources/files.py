"""Text lines and blobs, as batch tables and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BLOB = 10 * 1024 * 1024


def text_lines(spark: SparkSession, path: str, skip_empty: bool = False, name: str = "line") -> DataFrame:
    """One row per line of the files; with ``skip_empty`` without empty lines."""
    lines = spark.read.text(path).select(F.col("value").alias(name))
    return lines.where(F.length(name) > 0) if skip_empty else lines


def text_stream(spark: SparkSession, path: str, files_per_trigger: int = 1, name: str = "line") -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path).select(F.col("value").alias(name))


def blobs(spark: SparkSession, path: str, prefix: str = "", max_bytes: int = MAX_BLOB) -> DataFrame:
    """``path, bytes`` of the files below the size limit whose names start with ``prefix``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}*").load(path)
    return files.where(F.col("length") < max_bytes).select("path", F.col("content").alias("bytes"))


def omitted_blobs(spark: SparkSession, path: str, prefix: str = "", max_bytes: int = MAX_BLOB) -> DataFrame:
    """``path, length`` of the files that ``blobs`` leaves out for their size; their contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}*").load(path)
    return files.where(F.col("length") >= max_bytes).select("path", "length")


def blob_stream(spark: SparkSession, path: str, prefix: str = "", files_per_window: int = 1, max_bytes: int = MAX_BLOB) -> DataFrame:
    """The same as a stream, ``files_per_window`` files a micro-batch."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", f"{prefix}*").option("maxFilesPerTrigger", files_per_window).load(path)
    return files.where(F.col("length") < max_bytes).select("path", F.col("content").alias("bytes"))
