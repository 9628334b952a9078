"""Detections as a stream: late and repeated rows, and counts by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_detections(spark: SparkSession, folder: str, like: DataFrame, files_per_trigger: int | None = None) -> DataFrame:
    """New parquet files of a folder as they come; the schema is that of ``like``."""
    reader = spark.readStream.schema(like.schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(folder)


def window_counts(detections: DataFrame, lateness: str = "7 days", window: str = "1 day") -> DataFrame:
    """(window_start, class_name, boxes, videos) of captured_at; rows later than ``lateness`` behind the newest are dropped."""
    timed = detections.withColumn("captured_at", F.col("captured_at").cast("timestamp")).withWatermark("captured_at", lateness)
    counts = timed.groupBy(F.window("captured_at", window), "class_name").agg(F.count(F.lit(1)).alias("boxes"), F.approx_count_distinct("sequence_name").alias("videos"))
    return counts.select(F.col("window.start").alias("window_start"), "class_name", "boxes", "videos")


def without_repeats(detections: DataFrame, lateness: str = "7 days") -> DataFrame:
    """The first of equal boxes (sequence, frame, instance, corners) within the watermark, under whatever id."""
    timed = detections.withColumn("captured_at", F.col("captured_at").cast("timestamp")).withWatermark("captured_at", lateness)
    return timed.dropDuplicatesWithinWatermark(["sequence_name", "frame_id", "instance_id", "x1", "y1", "x2", "y2"])


def write_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs the stream over what is there, exactly once, and stops."""
    return stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
