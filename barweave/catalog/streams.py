"""Streaming queries, run to the end of the given tables and shown as tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.catalog.tables import FIVE_MINUTES, HOUR, bars, query, rounded, shown
from barweave.catalog.trading import PRICES, labelled
from barweave.plans.features import features
from barweave.session import shared_dir
from barweave.streaming.bars import bar_stream
from barweave.streaming.live import feature_batches, position_batches, read_signals, score_bars, trading_hours, write_stream
from barweave.streaming.positions import alerts

ONCE = {"availableNow": True}


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def tick_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("symbol"),
        F.col("value").alias("price"),
    )


def finished(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Run a stream to the end of its input and read what it wrote."""
    write_stream(df, folder, name, ONCE).awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


@query("stream_bars")
def _bars(spark, sf_dir):
    stream = bar_stream(tick_stream(spark, sf_dir), FIVE_MINUTES)
    return shown(finished(stream, new_folder(spark), "bars"), PRICES)


STREAMED = ["obv", "ema_21", "rsi_14", "macd", "adx_14"]


@query("stream_features")
def _features(spark, sf_dir):
    """The bars arrive in three parts; each batch goes on from the state of the one before."""
    folder, table = new_folder(spark), bars(spark, sf_dir)
    span = table.agg(F.min("time").alias("first"), F.max("time").alias("last")).first()
    part = F.least(F.lit(2), F.floor(3 * (F.unix_timestamp("time") - int(span["first"].timestamp())) / max(1, int((span["last"] - span["first"]).total_seconds()))))
    for i in range(3):
        table.where(part == i).write.parquet(f"{folder}/in/part={i}")
        arriving = spark.readStream.schema(table.schema).option("recursiveFileLookup", True).parquet(f"{folder}/in")
        feature_batches(arriving, folder, STREAMED, HOUR, trigger=ONCE).awaitTermination()
    return shown(spark.read.option("recursiveFileLookup", True).parquet(f"{folder}/features"), STREAMED)


@query("stream_positions")
def _positions(spark, sf_dir):
    folder = new_folder(spark)
    signals = labelled(spark, sf_dir).select("symbol", "time", "close", F.col("target").alias("signal"))
    signals.write.parquet(f"{folder}/signals")
    position_batches(read_signals(spark, folder), folder, HOUR, trigger=ONCE).awaitTermination()
    table = spark.read.parquet(f"{folder}/positions")
    numbers = ["entry_price", "exit_price", "pnl", "unrealized_pnl", "trade_id"]
    return table.select(
        "symbol", F.unix_timestamp("time").alias("time"), "state", *[rounded(c).alias(c) for c in numbers]
    )


def crossing_signal(bars: DataFrame) -> DataFrame:
    table = features(bars, ["sma_cross_signal_9_21"], HOUR, keep=["symbol", "time", "close"])
    return table.withColumn("signal", (F.col("sma_cross_signal_9_21") / 2).cast("int"))


@query("stream_alerts")
def _alerts(spark, sf_dir):
    folder = new_folder(spark)
    hourly = bar_stream(tick_stream(spark, sf_dir), HOUR)
    names = ["sma_cross_signal_9_21"]
    score_bars(trading_hours(hourly), folder, crossing_signal, HOUR, names, trigger=ONCE).awaitTermination()
    book = f"{folder}/book"
    position_batches(read_signals(spark, folder), book, HOUR, trigger=ONCE).awaitTermination()
    told = alerts(spark.read.parquet(f"{book}/positions"))
    return told.withColumn("time", F.unix_timestamp("time"))
