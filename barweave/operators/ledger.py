"""The trade ledger: what a long/short/flat rule does with a series of signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barweave import schema as S
from barweave.functions.rolling import Frame
from barweave.operators.blocks import number_rows, prefix
from barweave.operators.states import BLOCK_ROWS, block_positions
from barweave.plans.features import features
from barweave.plans.registry import Feature
from barweave.session import stage


def local_time(time: str, time_zone: str) -> Column:
    """Wall clock of an instant in the zone, as a timestamp without zone; the session's zone plays no part."""
    seconds = (F.unix_micros(F.col(time).cast("timestamp")) / F.lit(1_000_000)).cast("decimal(18,6)")
    utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)
    return F.convert_timezone(F.lit("UTC"), F.lit(time_zone), utc)


def local_clock(time: str, time_zone: str) -> Column:
    """Local time of day as HH:mm:ss."""
    return F.substring(local_time(time, time_zone).cast("string"), 12, 8)


def closing_bar(close_at: str, time_zone: str) -> Feature:
    """True on the first bar of a local day at or after `close_at`."""

    def make(w: Frame) -> Column:
        day = local_time("time", time_zone).cast("date")
        late = local_clock("time", time_zone) >= close_at
        late_before = F.lag(late).over(w.ordered) & (F.lag(day).over(w.ordered) == day)
        return late & ~F.coalesce(late_before, F.lit(False))

    return Feature("reset", ("time",), make, 1, True)


def ledger(
    signals: DataFrame,
    bar_seconds: int,
    spread: float = S.SPREAD,
    trade_value: float = S.TRADE_VALUE,
    leverage: float = S.LEVERAGE,
    exit_spreads: int = 2,
    close_at: str | None = None,
    time_zone: str = S.TIME_ZONE,
    close_at_end: bool = False,
    block_rows: int = BLOCK_ROWS,
    levels: int = 2,
) -> DataFrame:
    """One row per bar of signals(symbol, time, close, signal), with state and profit.

    A boolean column `reset` in the signals marks bars that close whatever their signal is.

    exit_spreads: how often the spread is taken at the exit: 2 in the back-test, 0 live.
    close_at: local time of day whose first bar closes an open position.
    close_at_end: close an open position on the last bar of a symbol.
    """
    given = "reset" in signals.columns
    columns = ["symbol", "time", "close", "signal", *(["reset"] if given else [])]
    numbered = number_rows(signals.select(*columns), bar_seconds)
    if given:
        rows = numbered
    elif close_at is None:
        rows = numbered.withColumn("reset", F.lit(False))
    else:
        rows = features(numbered, ["reset"], bar_seconds, own=[closing_bar(close_at, time_zone)])
    rows = stage(rows, "signals")
    if close_at_end:
        ends = rows.groupBy("symbol").agg(F.max("rn").alias("_end"))
        rows = rows.join(ends, "symbol").withColumn(
            "reset", F.col("reset") | (F.col("rn") == F.col("_end"))
        )
    rows = rows.withColumn("signal", F.coalesce(F.col("signal"), F.lit(0)).cast("int"))
    return _book(
        block_positions(rows, block_rows, levels), spread, trade_value * leverage, exit_spreads
    )


def _book(placed: DataFrame, spread: float, stake: float, exit_spreads: int) -> DataFrame:
    """Entries, exits and profits from the positions."""
    frame = Frame()
    before = F.coalesce(F.lag("st").over(frame.ordered), F.col("start"))
    rows = placed.withColumn("_was", before)
    opens = (F.col("_was") == 0) & (F.col("st") != 0)
    closes = (F.col("_was") != 0) & (F.col("st") == 0)
    rows = rows.withColumns(
        {
            "_opens": opens,
            "_closes": closes,
            "_side": F.when(closes, F.col("_was")).otherwise(F.col("st")),
            "entry_price": F.when(opens, F.col("close") + F.col("st") * spread),
        }
    )
    blocks = rows.groupBy("symbol", "blk").agg(
        F.count_if("_opens").alias("_trades"),
        F.max(F.when(F.col("_opens"), F.struct("rn", "entry_price"))).alias("_open"),
    )
    carried = prefix(blocks, sums=["_trades"], maxes=["_open"])
    rows = rows.withColumns(
        {
            "_count": F.sum(F.col("_opens").cast("long")).over(frame.running),
            "_last": F.last("entry_price", ignorenulls=True).over(frame.running),
        }
    ).join(carried, ["symbol", "blk"], "left")

    side, held = F.col("_side"), F.col("_side") != 0
    entry = F.when(held, F.coalesce(F.col("_last"), F.col("_open.entry_price")))
    rows = rows.withColumns({"_entry": entry})
    quantity = F.lit(stake) / F.col("_entry")
    mark = F.col("close") - side * (spread if exit_spreads else 0.0)
    booked = mark - side * (spread * max(exit_spreads - 1, 0))
    profit = quantity * (booked - F.col("_entry")) * side
    value = (mark - F.col("_entry")) * side * quantity
    is_long = side == 1
    state = (
        F.when(~held, S.FLAT)
        .when(F.col("_opens"), F.when(is_long, S.OPEN_LONG).otherwise(S.OPEN_SHORT))
        .when(F.col("_closes") & F.col("reset"), S.CLOSE_TIME)
        .when(F.col("_closes"), F.when(is_long, S.CLOSE_LONG).otherwise(S.CLOSE_SHORT))
        .otherwise(F.when(is_long, S.HOLD_LONG).otherwise(S.HOLD_SHORT))
    )
    rows = rows.withColumns({"pnl": F.when(F.col("_closes"), profit).otherwise(0.0), "_value": value})
    return rows.select(
        "symbol",
        "time",
        "close",
        "signal",
        state.alias("state"),
        "entry_price",
        F.when(F.col("_closes"), mark).alias("exit_price"),
        "pnl",
        (F.col("pnl") / stake * 100).alias("result_pct"),
        F.when(~held, None)
        .when(F.col("_opens"), 0.0)
        .when(F.col("_closes"), F.col("pnl"))
        .otherwise(F.col("_value"))
        .alias("running_pnl"),
        F.when(held, F.col("_count") + F.coalesce(F.col("_trades"), F.lit(0))).alias("trade_id"),
    )
