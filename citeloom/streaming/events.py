"""Event streams: sessions, windowed counts and first sightings, with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def marked(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events with a watermark; the other functions expect one, set once per stream."""
    return events.withWatermark("ts", late)


def once(events: DataFrame) -> DataFrame:
    """Events without those that come again within the watermark."""
    return events.dropDuplicatesWithinWatermark(["event_id"])


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user; a session is given out once the watermark has passed its end."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select("user_id", "w.start", "w.end", "n", "value")


def counts(events: DataFrame, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts by type in tumbling or sliding windows."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select("w.start", "w.end", "event_type", "n", "value")
