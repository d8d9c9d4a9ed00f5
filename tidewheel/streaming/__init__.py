"""Incremental counterparts of the panel's source, for event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewheel.sources.tables import SCHEMAS


def event_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """Events as they arrive in files under path; ts becomes a timestamp, which watermarks need."""
    stream = spark.readStream.schema(SCHEMAS["events"]).option("maxFilesPerTrigger", files).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly_counts(events: DataFrame, delay: str = "2 hours") -> DataFrame:
    """event_type, hour, n, value per tumbling hour; rows later than delay are dropped by the watermark."""
    grouped = events.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select("event_type", F.col("window.start").alias("hour"), "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "2 hours") -> DataFrame:
    """user_id, start, end, n per session of a user."""
    grouped = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return grouped.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, delay: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write what is there now and stop; a later call goes on from the checkpoint."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
