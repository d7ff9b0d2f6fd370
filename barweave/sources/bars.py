"""Reading, forming and writing bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barweave.operators.blocks import last_rows, number_rows
from barweave.schema import BAR


def read_bars(
    spark: SparkSession,
    path: str,
    format: str = "parquet",
    symbols: list[str] | None = None,
    num_candles: int | None = None,
    bar_seconds: int = 300,
    schema: T.StructType = BAR,
    timeframe: str | None = None,
) -> DataFrame:
    """Bars of the wanted symbols and timeframe, the newest `num_candles` of each when given.

    The filters reach the scan. A bad request fails before any work; a symbol without
    rows gives no rows.
    """
    if symbols is not None and (
        not symbols or any(not isinstance(s, str) or not s for s in symbols)
    ):
        raise ValueError(f"symbols must be non-empty strings: {symbols!r}")
    if num_candles is not None and num_candles < 1:
        raise ValueError(f"num_candles must be positive: {num_candles}")
    reader = spark.read.schema(schema).format(format)
    if format == "csv":
        reader = reader.option("header", True)
    bars = reader.load(path)
    if timeframe is not None:
        bars = bars.where(F.col("timeframe") == timeframe)
    if symbols is not None:
        bars = bars.where(F.col("symbol").isin(symbols))
    bars = missing_to_null(bars.select(*schema.names))
    return bars if num_candles is None else last_rows(bars, num_candles, bar_seconds)


def missing_to_null(df: DataFrame) -> DataFrame:
    """NaN and infinities as NULL in every float column: the only missing value from here on."""
    floats = {
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.select(
        *[
            F.when(F.abs(F.col(f"`{c}`")) < float("inf"), F.col(f"`{c}`").cast("double")).alias(c) if c in floats else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def from_epoch(df: DataFrame, column: str = "time") -> DataFrame:
    """Epoch seconds to timestamps."""
    return df.withColumn(column, F.timestamp_seconds(F.col(column)))


def from_text(df: DataFrame, column: str = "time", pattern: str | None = None) -> DataFrame:
    """Text to timestamps."""
    return df.withColumn(column, F.to_timestamp(F.col(column), pattern))


def bars_from_ticks(ticks: DataFrame, bar_seconds: int, market: str | None = None) -> DataFrame:
    """OHLC bars from ticks(event_id, ts, symbol, price); bars exist only where ticks do.

    Everything is a plain aggregate, so ticks are combined before the shuffle.
    With `market`, all ticks together form the bars of one symbol of that name.
    """
    if market is not None:
        ticks = ticks.withColumn("symbol", F.lit(market))
    step = F.lit(bar_seconds)
    start = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / step) * step)
    order = F.struct("ts", "event_id")
    return ticks.groupBy("symbol", start.alias("time")).agg(
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.count(F.lit(1)).alias("tick_volume"),
    )


def volume_column(df: DataFrame) -> DataFrame:
    """`tick_volume`, taken from `volume` where the table has no tick volume."""
    if "tick_volume" in df.columns:
        return df
    return df.withColumn("tick_volume", F.col("volume").cast("long"))


def write_bars(
    df: DataFrame, path: str, timeframe: str, format: str = "parquet", mode: str = "overwrite"
) -> None:
    """One table for all symbols, partitioned for pruning.

    Rows are spread over (symbol, month) before the write, so a symbol with many bars is written
    by many tasks while each folder still gets few files.
    """
    month = F.date_trunc("month", F.col("time"))
    writer = (
        df.withColumn("timeframe", F.lit(timeframe))
        .repartition(F.col("symbol"), month)
        .write.mode(mode)
        .partitionBy("symbol", "timeframe")
        .format(format)
    )
    if format == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def latest_quotes(ticks: DataFrame, half_spread: Column | float) -> DataFrame:
    """One (bid, ask) per symbol around its newest price."""
    newest = ticks.groupBy("symbol").agg(F.max_by("price", F.struct("ts", "event_id")).alias("_p"))
    half = F.lit(half_spread) if isinstance(half_spread, float) else half_spread
    return newest.select("symbol", (F.col("_p") - half).alias("bid"), (F.col("_p") + half).alias("ask"))


def market_returns(market_bars: DataFrame, bar_seconds: int) -> DataFrame:
    """(time, market_log_ret) of a benchmark series; its first bar has no return."""
    from barweave.plans.features import features

    returns = features(market_bars, ["log_ret"], bar_seconds, keep=["time"])
    return returns.select("time", F.col("log_ret").alias("market_log_ret")).where(
        F.col("market_log_ret").isNotNull()
    )


__all__ = [
    "bars_from_ticks",
    "from_epoch",
    "from_text",
    "last_rows",
    "latest_quotes",
    "market_returns",
    "missing_to_null",
    "number_rows",
    "read_bars",
    "volume_column",
    "write_bars",
]
