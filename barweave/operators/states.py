"""Positions from signals: flat, long or short per row, for series of any length.

A signal moves the position one step up or down between -1 and 1: flat opens, an opposite
signal closes to flat, an equal one holds. A reset row closes to flat whatever its signal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barweave.functions.rolling import Frame
from barweave.operators.blocks import lay_out

BLOCK_ROWS = 1024
# A block without equal neighbours or resets acts on the position like at most three signals.
SLOTS = 3


def _walk(rows: DataFrame, frame: Frame, start: Column) -> DataFrame:
    """Add `st`, the position after each row, with `start` the position before the block.

    Two equal non-zero signals in a row, or a reset, fix the position whatever came before.
    Between such rows signals alternate and their plain sum is the change of position.
    """
    step = F.when(F.col("reset"), F.lit(0)).otherwise(F.col("signal"))
    rows = rows.withColumns({"_step": step})
    mark = F.when(F.col("reset"), F.lit(0)).when(F.col("_step") != 0, F.col("_step"))
    rows = rows.withColumns(
        {
            "_sum": F.sum("_step").over(frame.running),
            "_seen": F.last(mark, ignorenulls=True).over(frame.before),
        }
    )
    fixed = (F.col("_step") != 0) & (F.col("_step") == F.coalesce(F.col("_seen"), F.nullif(start, F.lit(0))))
    rows = rows.withColumn("_fixed", F.coalesce(fixed, F.lit(False)))
    base = F.when(F.col("reset"), F.col("_sum")).when(F.col("_fixed"), F.col("_sum") - F.col("_step"))
    rows = rows.withColumn("_base", F.last(base, ignorenulls=True).over(frame.running))
    return rows.withColumn("st", (F.col("_sum") - F.coalesce(F.col("_base"), -start)).cast("int"))


_HELPERS = ["_step", "_sum", "_seen", "_fixed", "_base"]


def block_starts(laid: DataFrame, block_rows: int, levels: int) -> DataFrame:
    """(symbol, blk, start): the position before each block, for all blocks but the first.

    Every block is replaced by at most three signals with the same effect, and the shorter
    series is solved the same way; `levels` bounds the depth.
    """
    frame = Frame()
    walked = _walk(laid, frame, F.lit(0))
    moved = F.col("_step") != 0
    blocks = walked.groupBy("symbol", "blk").agg(
        F.bool_or(F.col("_fixed") | F.col("reset")).alias("constant"),
        F.max_by("st", "rn").alias("end"),
        F.min_by(F.when(moved, F.col("_step")), F.when(moved, F.col("rn"))).alias("first"),
        F.count_if(moved).alias("moves"),
    )
    none, end, first = F.lit(0), F.col("end"), F.col("first").cast("int")
    slots = (
        F.when(F.col("constant") & (end != 0), F.array(end, end, none))
        .when(F.col("constant"), F.array(F.lit(1), F.lit(1), F.lit(-1)))
        .when(F.col("moves") == 0, F.array(none, none, none))
        .when(F.col("moves") % 2 == 1, F.array(first, none, none))
        .otherwise(F.array(first, -first, none))
    )
    shorter = blocks.select("symbol", "blk", F.posexplode(slots).alias("_i", "signal")).select(
        "symbol", (F.col("blk") * SLOTS + F.col("_i")).alias("rn"), "signal", F.lit(False).alias("reset")
    )
    solved = positions(shorter, block_rows, levels)
    last_slot = F.col("rn") % SLOTS == SLOTS - 1
    return solved.where(last_slot).select(
        "symbol", (F.floor(F.col("rn") / SLOTS) + 1).cast("long").alias("blk"), F.col("st").alias("start")
    )


def positions(rows: DataFrame, block_rows: int = BLOCK_ROWS, levels: int = 2) -> DataFrame:
    """Add `st` to rows(symbol, rn, signal, reset, ...).

    Below the last level the series, shortened by (3 / block_rows) per level, is one window.
    """
    if levels == 0:
        return _walk(rows, Frame(("symbol",)), F.lit(0)).drop(*_HELPERS)
    return block_positions(rows, block_rows, levels).drop("start", "blk")


def block_positions(rows: DataFrame, block_rows: int, levels: int) -> DataFrame:
    """As `positions`, keeping `blk` and the block's `start` position."""
    laid = lay_out(rows, block_rows)
    starts = block_starts(laid, block_rows, levels - 1)
    joined = laid.join(starts, ["symbol", "blk"], "left").withColumn(
        "start", F.coalesce(F.col("start"), F.lit(0))
    )
    return _walk(joined, Frame(), F.col("start")).drop(*_HELPERS)
