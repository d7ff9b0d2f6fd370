"""Queries on bars, labels, trades and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.catalog.tables import FIVE_MINUTES, HOUR, bars, query, rounded, shown, ticks
from barweave.operators.labels import reversal_label
from barweave.operators.ledger import ledger, local_clock
from barweave.operators.orders import order_intents
from barweave.operators import reports
from barweave.operators.validate import with_reason
from barweave.plans.features import features
from barweave.schema import SESSION_END, SESSION_START, TIME_ZONE
from barweave.session import shared_dir
from barweave.sources.bars import from_epoch, from_text, last_rows, latest_quotes

PRICES = ["open", "high", "low", "close", "tick_volume"]


@query("hourly_bars")
def _hourly(spark, sf_dir):
    return shown(bars(spark, sf_dir), PRICES)


@query("five_minute_bars")
def _five_minutes(spark, sf_dir):
    return shown(bars(spark, sf_dir, FIVE_MINUTES), PRICES)


@query("daily_order_bars")
def _daily_orders(spark, sf_dir):
    from barweave.sources.bars import bars_from_ticks

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("event_id"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.col("o_orderpriority").alias("symbol"),
        F.col("o_totalprice").alias("price"),
    )
    daily = bars_from_ticks(orders, 86400)
    return shown(features(daily, ["sma_9", "log_ret"], 86400), [*PRICES, "sma_9", "log_ret"])


@query("newest_bars")
def _newest(spark, sf_dir):
    return shown(last_rows(bars(spark, sf_dir), 60, HOUR), PRICES)


@query("epoch_and_text_times")
def _times(spark, sf_dir):
    table = ticks(spark, sf_dir).select(
        "event_id",
        F.unix_timestamp("ts").alias("seconds"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("text"),
    )
    parsed = from_text(from_epoch(table, "seconds"), "text")
    return parsed.select(
        "event_id",
        F.date_format("seconds", "yyyy-MM-dd HH:mm:ss").alias("from_seconds"),
        F.unix_timestamp("text").alias("from_text"),
    )


@query("csv_round_trip")
def _csv(spark, sf_dir):
    from barweave.schema import BAR
    from barweave.sources.bars import read_bars, write_bars
    from pyspark.sql import types as T

    path = f"{shared_dir(spark)}/bars-{uuid.uuid4().hex}"
    write_bars(bars(spark, sf_dir), path, "H1", format="csv")
    schema = T.StructType([f for f in BAR.fields if f.name != "spread"])
    return shown(read_bars(spark, path, "csv", schema=schema), PRICES)


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tick as a one-minute bar from the previous price rule: repeated minutes occur."""
    return ticks(spark, sf_dir).select(
        "symbol",
        F.date_trunc("minute", "ts").alias("time"),
        (F.col("price") * 1.01).alias("open"),
        (F.col("price") * F.when(F.col("event_id") % 7 == 0, 1.005).otherwise(1.02)).alias("high"),
        (F.col("price") * F.when(F.col("event_id") % 11 == 0, 1.001).otherwise(0.98)).alias("low"),
        F.col("price").alias("close"),
        F.lit(1).cast("long").alias("tick_volume"),
    )


@query("bar_validation")
def _validation(spark, sf_dir):
    checked = with_reason(raw_bars(spark, sf_dir)).withColumn("reason", F.coalesce("reason", F.lit("good")))
    return checked.groupBy("symbol", "reason").agg(F.count(F.lit(1)).alias("bars"))


@query("order_intents")
def _orders(spark, sf_dir):
    table = ticks(spark, sf_dir)
    quotes = latest_quotes(table, 0.025)
    info = table.groupBy("symbol").agg((F.avg("price") / 100).alias("volume_min"))
    orders = table.select(
        F.col("event_id").alias("order_id"),
        "symbol",
        F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell").alias("side"),
        F.col("price").alias("value"),
    )
    return order_intents(orders, quotes, info).select(
        "order_id",
        "symbol",
        "side",
        rounded("price").alias("price"),
        rounded("volume").alias("volume"),
        F.col("magic").cast("long").alias("magic"),
        F.col("deviation").cast("long").alias("deviation"),
        F.col("rejected").cast("long").alias("rejected"),
    )


@query("session_hours")
def _hours(spark, sf_dir):
    table = bars(spark, sf_dir)
    clock = local_clock("time", TIME_ZONE)
    return shown(table.where(clock.between(SESSION_START, SESSION_END)), ["close"])


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reversal_label(bars(spark, sf_dir), HOUR)


@query("reversal_label")
def _label(spark, sf_dir):
    return shown(labelled(spark, sf_dir), ["current_return", "future_return", "target"])


@query("label_counts")
def _label_counts(spark, sf_dir):
    return (
        labelled(spark, sf_dir)
        .groupBy("symbol", F.col("target").cast("long").alias("target"))
        .agg(F.count(F.lit(1)).alias("bars"))
    )


def label_ledger(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    signals = labelled(spark, sf_dir).select("symbol", "time", "close", F.col("target").alias("signal"))
    return ledger(signals, HOUR, **options)


def crossing_ledger(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """Buy and sell where the 9-bar mean crosses the 21-bar mean."""
    table = features(bars(spark, sf_dir), ["sma_cross_signal_9_21"], HOUR, keep=["symbol", "time", "close"])
    signal = F.coalesce(F.col("sma_cross_signal_9_21") / 2, F.lit(0)).cast("int")
    return ledger(table.select("symbol", "time", "close", signal.alias("signal")), HOUR, **options)


def _shown_ledger(table: DataFrame) -> DataFrame:
    numbers = ["entry_price", "exit_price", "pnl", "result_pct", "running_pnl", "trade_id"]
    return table.select(
        "symbol",
        F.unix_timestamp("time").alias("time"),
        "state",
        *[rounded(c).alias(c) for c in numbers],
    )


@query("ledger_of_labels")
def _ledger_labels(spark, sf_dir):
    return _shown_ledger(label_ledger(spark, sf_dir))


@query("ledger_of_crossings")
def _ledger_crossings(spark, sf_dir):
    return _shown_ledger(crossing_ledger(spark, sf_dir))


@query("ledger_with_session_close")
def _ledger_session(spark, sf_dir):
    return _shown_ledger(label_ledger(spark, sf_dir, close_at="17:55:00"))


@query("ledger_closed_at_end")
def _ledger_end(spark, sf_dir):
    return _shown_ledger(label_ledger(spark, sf_dir, close_at_end=True))


@query("trades")
def _trades(spark, sf_dir):
    table = reports.trades(label_ledger(spark, sf_dir))
    return table.select(
        "symbol",
        "trade_id",
        F.unix_timestamp("open_time").alias("open_time"),
        rounded(F.unix_timestamp("close_time")).alias("close_time"),
        F.col("side").cast("long").alias("side"),
        *[rounded(c).alias(c) for c in ("entry_price", "exit_price", "bars_held", "pnl")],
    )


COUNTS = ["num_transactions", "num_profit_transactions", "num_loss_transactions", "num_trades"]


def _shown_results(table: DataFrame, period: str) -> DataFrame:
    return table.select(
        "symbol",
        F.col(period).cast("string").alias(period),
        rounded("total_profit_loss").alias("total_profit_loss"),
        *COUNTS,
    )


@query("daily_results")
def _daily(spark, sf_dir):
    return _shown_results(reports.daily_results(crossing_ledger(spark, sf_dir)), "date")


@query("monthly_results")
def _monthly(spark, sf_dir):
    return _shown_results(reports.monthly_results(label_ledger(spark, sf_dir)), "month")


@query("monthly_mean")
def _monthly_mean(spark, sf_dir):
    table = reports.monthly_mean(reports.monthly_results(label_ledger(spark, sf_dir)))
    return table.select("symbol", rounded("monthly_mean").alias("monthly_mean"))


@query("last_days")
def _last_days(spark, sf_dir):
    return _shown_results(reports.last_days(reports.daily_results(label_ledger(spark, sf_dir))), "date")


@query("recent_statistics")
def _recent(spark, sf_dir):
    table = reports.recent_statistics(reports.daily_results(label_ledger(spark, sf_dir)))
    return table.select("symbol", *[rounded(c).alias(c) for c in ("total_30", "mean_30", "std_30")])


@query("closed_trades")
def _closed(spark, sf_dir):
    table = reports.closed_trades(label_ledger(spark, sf_dir))
    money = ["sum_profit", "sum_loss", "max_gain", "max_loss"]
    return table.select("symbol", "wins", "losses", *[rounded(c).alias(c) for c in money])


@query("summary")
def _summary(spark, sf_dir):
    table = reports.summary(label_ledger(spark, sf_dir))
    return table.select("symbol", *[rounded(c).alias(c) for c in ("total_pnl", "roi_pct", "final_capital")])


@query("results_table")
def _results(spark, sf_dir):
    from barweave.session import stage

    book = stage(label_ledger(spark, sf_dir), "ledger")
    table = reports.results_table(reports.summary(book), reports.closed_trades(book))
    numbers = [c for c in table.columns if c not in ("symbol", "wins", "losses")]
    return table.select("symbol", "wins", "losses", *[rounded(c).alias(c) for c in numbers])
