"""Streaming forms of the incremental reads: deduplicated ingest and sliding activity windows with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_a_batch: int = 16) -> DataFrame:
    """Event files as they arrive in a folder; `at` is the event time."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_batch).parquet(folder).withColumn("at", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Events once by id, as far apart as the watermark allows; state older than that is dropped."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])


def velocity(events: DataFrame, window: str = "10 days", slide: str = "1 day", least: int = 5) -> DataFrame:
    """Users with at least `least` events in a sliding window; windows close once the watermark has passed them."""
    counted = events.groupBy(F.window("at", window, slide), "user_id").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= least).select(F.col("window.start").alias("window_start"), "user_id", "n")
