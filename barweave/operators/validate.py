"""Checking bars before features are computed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRICES = ["open", "high", "low", "close"]
REQUIRED = ["symbol", "time", *PRICES, "tick_volume"]


def with_reason(bars: DataFrame) -> DataFrame:
    """Add `reason`: NULL for a good bar, else the first rule it breaks."""
    missing = [c for c in REQUIRED if c not in bars.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    absent = F.lit(False)
    for c in REQUIRED:
        absent = absent | F.col(c).isNull()
    for c in PRICES:
        absent = absent | F.isnan(c)
    # Only repeated keys are joined back, so a frequent key is one small row on that side.
    repeated = (
        bars.groupBy("symbol", "time")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > 1)
        .select("symbol", "time", F.lit(True).alias("_repeated"))
    )
    reason = (
        F.when(absent, "missing")
        .when(F.col("high") < F.greatest("open", "close", "low"), "high")
        .when(F.col("low") > F.least("open", "close"), "low")
        .when(F.col("tick_volume") < 0, "volume")
        .when(F.col("_repeated"), "repeated")
    )
    return bars.join(repeated, ["symbol", "time"], "left").withColumn("reason", reason).drop("_repeated")


def validate(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects with their reason)."""
    checked = with_reason(bars)
    return checked.where(F.col("reason").isNull()).drop("reason"), checked.where(F.col("reason").isNotNull())
