"""The library's inputs, read from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.plans.features import features
from barweave.plans.registry import q
from barweave.sources.bars import bars_from_ticks

HOUR = 3600
FIVE_MINUTES = 300
MARKET = "ALL"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        return fn

    return register


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("symbol"),
        F.col("value").alias("price"),
    )


def bars(spark: SparkSession, sf_dir: str, seconds: int = HOUR, market: str | None = None) -> DataFrame:
    return bars_from_ticks(ticks(spark, sf_dir), seconds, market)


def rounded(c: Column | str) -> Column:
    """Fixed decimals and no negative zero; exact ties, common in means of prices, go up."""
    c = F.col(f"`{c}`") if isinstance(c, str) else c
    return F.round(c.cast("double") + F.lit(3e-10), 6) + F.lit(0.0)


def shown(df: DataFrame, names: list[str], rename: dict[str, str] | None = None) -> DataFrame:
    """symbol, time as epoch seconds, and the rounded columns."""
    rename = rename or {}
    return df.select(
        "symbol", F.unix_timestamp("time").alias("time"), *[rounded(n).alias(rename.get(n, n)) for n in names]
    )


# Column names that need quoting in most engines get plain ones in query results.
PLAIN = {
    "+DM": "plus_dm",
    "-DM": "minus_dm",
    "+DM_sum": "plus_dm_sum",
    "-DM_sum": "minus_dm_sum",
    "+VI": "plus_vi",
    "-VI": "minus_vi",
    "TR": "tr",
    "TR_sum": "tr_sum",
}


def feature_query(name: str, columns: str, seconds: int = HOUR) -> None:
    """Register a query that shows feature columns of the bars."""
    names = columns.split()
    QUERIES[name] = lambda spark, sf_dir: shown(
        features(bars(spark, sf_dir, seconds), names, seconds), names, PLAIN
    )


__all__ = ["HOUR", "FIVE_MINUTES", "MARKET", "QUERIES", "bars", "feature_query", "q", "query", "rounded", "shown", "ticks"]
