"""Streams of pages and submissions (an extension; the batch operators are the same)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import PAGE


def pages(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Pages of JSON lines as they arrive, with the file they came in."""
    stream = spark.readStream.schema(PAGE).option("maxFilesPerTrigger", files_per_trigger).json(folder)
    return stream.withColumn("path", F.col("_metadata.file_path"))


def first_deliveries(stream: DataFrame, keys: list[str], time: str, delay: str = "1 day") -> DataFrame:
    """Each key once while its watermark lasts; the state is bounded by the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def counts(stream: DataFrame, time: str, by: list[str], window: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Rows by tumbling window; late rows count until the watermark passes their window."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, window), *by).agg(F.count("*").alias("rows"))


def sessions(stream: DataFrame, time: str, by: list[str], gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    """Rows by session of each key."""
    return stream.withWatermark(time, delay).groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("rows"))
