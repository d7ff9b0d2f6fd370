"""Haar approximation of the newest bars, placed on the first rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barweave.operators.blocks import last_rows, number_rows


def wavelet_coeff(bars: DataFrame, bar_seconds: int, n: int = 30) -> DataFrame:
    """Add `wavelet_coeff`: pair values of the last n closes on rows 0..n/2-1, 0 elsewhere.

    Looks ahead by design; `haar_approx` is the causal form.
    """
    newest = last_rows(bars.select("symbol", "time", "close"), n, bar_seconds)
    pairs = (
        number_rows(newest, bar_seconds)
        .groupBy("symbol", F.floor(F.col("rn") / 2).cast("long").alias("rn"))
        .agg((F.sum("close") / F.sqrt(F.lit(2.0))).alias("wavelet_coeff"))
    )
    return (
        number_rows(bars, bar_seconds)
        .join(pairs, ["symbol", "rn"], "left")
        .withColumn("wavelet_coeff", F.coalesce(F.col("wavelet_coeff"), F.lit(0.0)))
        .drop("rn")
    )
