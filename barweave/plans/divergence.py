"""MACD divergence: whole-series z-scores of the histogram and the close."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barweave.functions.rolling import ratio
from barweave.plans.features import features
from barweave.session import stage


def macd_divergence(bars: DataFrame, bar_seconds: int) -> DataFrame:
    """Add macd_hist and macd_divergence = z(macd_hist) - z(close), over rows with a histogram."""
    table = stage(features(bars, ["macd_hist"], bar_seconds), "macd")
    present = table.where(F.col("macd_hist").isNotNull())
    moments = present.groupBy("symbol").agg(
        *[F.avg(c).alias(f"_m_{c}") for c in ("macd_hist", "close")],
        *[F.stddev_pop(c).alias(f"_s_{c}") for c in ("macd_hist", "close")],
    )

    def z(c: str):
        return ratio(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}"))

    joined = table.join(moments, "symbol", "left")
    return joined.select(*table.columns, (z("macd_hist") - z("close")).alias("macd_divergence"))
