"""Measures of a symbol against a benchmark series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barweave.plans.features import features
from barweave.plans.registry import Feature


def _beta(w):
    a, m, n = F.col("log_ret"), F.col("market_log_ret"), 30
    return F.try_divide(w.full(n, F.covar_samp(a, m), a), w.full(n, F.var_samp(m), m))


def _correlation(w):
    a, m, n = F.col("log_ret"), F.col("market_log_ret"), 30
    spread = w.std_pop(a, n) * w.std_pop(m, n)
    return F.try_divide(w.full(n, F.covar_pop(a, m), a), spread)


RULES = [
    Feature("beta", ("log_ret", "market_log_ret"), _beta, 29, True),
    Feature("market_correlation", ("log_ret", "market_log_ret"), _correlation, 29, True),
]


def market_risk(returns: DataFrame, market: DataFrame, bar_seconds: int, **options) -> DataFrame:
    """(symbol, time, beta, market_correlation) over the last 30 bars both sides have.

    returns(symbol, time, log_ret); market(time, market_log_ret).
    """
    both = (
        returns.select("symbol", "time", "log_ret")
        .where(F.col("log_ret").isNotNull())
        .join(market.where(F.col("market_log_ret").isNotNull()), "time")
    )
    names = [r.name for r in RULES]
    return features(both, names, bar_seconds, own=RULES, keep=["symbol", "time"], **options)


def add_market_risk(bars: DataFrame, market: DataFrame, bar_seconds: int, **options) -> DataFrame:
    """`bars` (with log_ret) and the two measures; missing where the market has no bar."""
    return bars.join(market_risk(bars, market, bar_seconds, **options), ["symbol", "time"], "left")
