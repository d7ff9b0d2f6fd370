"""Aggregates of a trade ledger. Plain groupings, combined before any shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barweave import schema as S


def _results(ledger: DataFrame, period: Column) -> DataFrame:
    pnl = F.col("pnl")
    return ledger.groupBy("symbol", period).agg(
        F.sum(pnl).alias("total_profit_loss"),
        F.count(F.lit(1)).alias("num_transactions"),
        F.count_if(pnl > 0).alias("num_profit_transactions"),
        F.count_if(pnl < 0).alias("num_loss_transactions"),
        F.count_if(F.col("state").isin(S.CLOSED)).alias("num_trades"),
    )


def daily_results(ledger: DataFrame) -> DataFrame:
    """Per symbol and day. `num_transactions` counts bars, `num_trades` closed trades."""
    return _results(ledger, F.to_date("time").alias("date"))


def monthly_results(ledger: DataFrame) -> DataFrame:
    return _results(ledger, F.to_date(F.date_trunc("month", "time")).alias("month"))


def last_days(daily: DataFrame, days: int = 30) -> DataFrame:
    """Days of each symbol not older than `days` before its newest day."""
    newest = daily.groupBy("symbol").agg(F.max("date").alias("_newest"))
    recent = F.col("date") >= F.date_sub(F.col("_newest"), days)
    return daily.join(newest, "symbol").where(recent).drop("_newest")


def recent_statistics(daily: DataFrame, days: int = 30) -> DataFrame:
    """Sum and mean of the recent days' profit; the deviation is over all days."""
    newest = daily.groupBy("symbol").agg(F.max("date").alias("_newest"))
    recent = F.when(F.col("date") >= F.date_sub(F.col("_newest"), days), F.col("total_profit_loss"))
    return (
        daily.join(newest, "symbol")
        .groupBy("symbol")
        .agg(
            F.sum(recent).alias("total_30"),
            F.avg(recent).alias("mean_30"),
            F.stddev_samp("total_profit_loss").alias("std_30"),
        )
    )


def monthly_mean(monthly: DataFrame) -> DataFrame:
    return monthly.groupBy("symbol").agg(F.avg("total_profit_loss").alias("monthly_mean"))


def closed_trades(ledger: DataFrame) -> DataFrame:
    """Statistics of the closing rows per symbol."""
    pnl = F.col("pnl")
    return (
        ledger.where(F.col("state").isin(S.CLOSED))
        .groupBy("symbol")
        .agg(
            F.count_if(pnl > 0).alias("wins"),
            F.count_if(pnl < 0).alias("losses"),
            F.coalesce(F.sum(F.when(pnl > 0, pnl)), F.lit(0.0)).alias("sum_profit"),
            F.coalesce(F.sum(F.when(pnl < 0, pnl)), F.lit(0.0)).alias("sum_loss"),
            F.max(pnl).alias("max_gain"),
            F.min(pnl).alias("max_loss"),
        )
    )


def summary(ledger: DataFrame, capital: float = S.CAPITAL) -> DataFrame:
    total = F.sum("pnl")
    return ledger.groupBy("symbol").agg(
        total.alias("total_pnl"),
        (total / capital * 100).alias("roi_pct"),
        (total + capital).alias("final_capital"),
    )


def trades(ledger: DataFrame) -> DataFrame:
    """One row per trade; an open last trade has no close time and no exit."""
    closed = F.col("state").isin(S.CLOSED)
    return (
        ledger.where(F.col("trade_id").isNotNull())
        .groupBy("symbol", "trade_id")
        .agg(
            F.min("time").alias("open_time"),
            F.max(F.when(closed, F.col("time"))).alias("close_time"),
            F.max(F.when(F.col("state") == S.OPEN_LONG, 1).when(F.col("state") == S.OPEN_SHORT, -1)).alias("side"),
            F.max("entry_price").alias("entry_price"),
            F.max("exit_price").alias("exit_price"),
            (F.count(F.lit(1)) - 1).alias("bars_held"),
            F.sum("pnl").alias("pnl"),
        )
    )


def results_table(summary_: DataFrame, closed: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """The consolidated table: one row per symbol, with the model accuracy when given."""
    table = summary_.join(closed, "symbol", "left")
    return table if scores is None else table.join(scores, "symbol", "left")
