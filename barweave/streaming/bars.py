"""Bars from a stream of ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.schema import TICK

DELAY = "10 minutes"


def read_tick_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of ticks as they arrive."""
    reader = spark.readStream.schema(TICK)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def bar_stream(ticks: DataFrame, bar_seconds: int, delay: str = DELAY, unique: bool = True) -> DataFrame:
    """Closed bars of ticks(event_id, ts, symbol, price).

    A bar appears once the watermark has passed its end; later ticks of it are dropped, and so
    are repeated event ids.
    """
    marked = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    if unique:
        marked = marked.dropDuplicatesWithinWatermark(["event_id"])
    order = F.struct("ts", "event_id")
    return (
        marked.groupBy("symbol", F.window("ts", f"{bar_seconds} seconds").alias("w"))
        .agg(
            F.min_by("price", order).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", order).alias("close"),
            F.count(F.lit(1)).alias("tick_volume"),
        )
        .select("symbol", F.col("w.start").alias("time"), "open", "high", "low", "close", "tick_volume")
    )
