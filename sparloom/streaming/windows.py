"""Streams of events: windows with watermarks, and files as a source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Counts and sums by window and type; late: the watermark of a stream."""
    rows = timed(events)
    rows = rows.withWatermark("ts", late) if late else rows
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour") -> DataFrame:
    out = timed(events).groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
    return out.select(F.col("w.start").alias("start"), "n", "users")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    out = timed(events).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return out.select("user_id", F.col("w.start").alias("start"), "last", "n")


def read_files(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int = 4) -> DataFrame:
    """A folder of Parquet files as a stream, a few files a micro-batch."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_once(stream: DataFrame, checkpoint: str, sink: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns the Parquet sink's rows."""
    job = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)
    job.awaitTermination()
    return stream.sparkSession.read.parquet(sink)
