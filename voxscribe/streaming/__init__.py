"""Normalization of streams: each row on its own, no state, so no watermark is needed; windowed counts take one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxscribe.functions.temporal import Context
from voxscribe.plans.candidates import normalized


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A stream of transcripts from text files that arrive in a folder."""
    return spark.readStream.format("text").load(path).withColumnRenamed("value", "text")


def normalize_stream(texts: DataFrame, text: str = "text", context: Context | None = None) -> DataFrame:
    return normalized(texts, text, context)


def edited_per_window(texts: DataFrame, at: str, window: str = "5 minutes", late: str = "10 minutes", text: str = "text") -> DataFrame:
    """Rows and rewritten rows by event-time window; rows later than `late` are left out."""
    out = normalized(texts, text).withWatermark(at, late)
    return out.groupBy(F.window(at, window)).agg(F.count("*").alias("rows"), F.sum((F.col(text) != F.col("normalized")).cast("int")).alias("edited"))
