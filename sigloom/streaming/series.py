"""Streaming forms of the ordered operators: groups of pictures and windows over events, as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the Parquet files that come into a folder, times in UTC."""
    return spark.readStream.schema(EVENTS).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def gop_counts(events: DataFrame, days: int = 5, origin: str = "2024-01-01") -> DataFrame:
    """(gop, n, total): events per group of so many days, a count-based tumbling group (O14); the same over batches and streams."""
    day = F.datediff(F.col("ts").cast("date"), F.lit(origin).cast("date"))
    return events.groupBy(F.floor(day / days).cast("int").alias("gop")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("total"))


def window_counts(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, event_type, n): tumbling windows with a bound on lateness."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def run_once(spark: SparkSession, stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Drain what is there and return the result as a table of the session."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
