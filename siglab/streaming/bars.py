"""Tumbling-window bars of events, with a watermark for late ones; the plan is one for batch and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def bars(events: DataFrame, width: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    """series_id (event type), ts (a window's begin), n, close (the last value), low, high, mean of each window."""
    late = events.withWatermark("ts", watermark) if events.isStreaming else events
    last = F.max_by("value", F.struct("ts", "event_id"))
    grouped = late.groupBy(F.col("event_type").alias("series_id"), F.window("ts", width).alias("w"))
    return grouped.agg(F.count("*").alias("n"), last.alias("close"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean")).select("series_id", F.col("w.start").alias("ts"), "n", "close", "low", "high", "mean")


def read_events(spark: SparkSession, path: str, files_a_trigger: int = 1) -> DataFrame:
    """A stream over Parquet files of events as they appear in a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def write_bars(stream: DataFrame, path: str, checkpoint: str):
    """A running query that appends finished bars to Parquet, exactly once."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
