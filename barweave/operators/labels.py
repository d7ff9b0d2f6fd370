"""The trend-reversal label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barweave import schema as S
from barweave.functions.rolling import Frame, ratio
from barweave.operators.blocks import lay_out, number_rows, own_row

BLOCK_ROWS = 256


def reversal_label(
    bars: DataFrame,
    bar_seconds: int,
    horizon: int = S.HORIZON,
    threshold: float = S.THRESHOLD,
    block_rows: int | None = None,
) -> DataFrame:
    """Add current_return, future_return and target; the last `horizon` rows of a symbol go.

    1: the bar fell and the price `horizon` bars on is above it by more than the threshold;
    -1: the bar rose and it is below by more; else 0. A table with a target stays as it is.
    """
    if "target" in bars.columns:
        return bars
    rows = block_rows or max(BLOCK_ROWS, 8 * (horizon + 1))
    numbered = bars if "rn" in bars.columns else number_rows(bars, bar_seconds)
    order = Frame().ordered
    close = F.col("close")
    laid = lay_out(numbered, rows, back=1, ahead=horizon).withColumns(
        {
            "current_return": ratio(close, F.lag("close").over(order)) - 1,
            "future_return": ratio(F.lead("close", horizon).over(order), close) - 1,
            "_later": F.lead("rn", horizon).over(order),
        }
    )
    now, then = F.col("current_return"), F.col("future_return")
    target = (
        F.when((now < 0) & (then > threshold), 1).when((now > 0) & (then < -threshold), -1).otherwise(0)
    )
    kept = laid.where(own_row(rows) & F.col("_later").isNotNull()).withColumn("target", target)
    return kept.drop("blk", "_later", *([] if "rn" in bars.columns else ["rn"]))
