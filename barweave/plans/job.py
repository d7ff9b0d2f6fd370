"""The feature job: bars of all symbols in, one wide table out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barweave.operators.market import add_market_risk
from barweave.operators.unit_root import rolling_adf
from barweave.operators.validate import validate
from barweave.operators.wavelet import wavelet_coeff
from barweave.plans.features import add_quotes, features
from barweave.plans.registry import resolve, set_columns
from barweave.schema import MODEL_FEATURES
from barweave.session import stage
from barweave.sources.bars import last_rows, read_bars, write_bars

# The sets of the standard feature table, in order.
STANDARD_SETS = ["core", "ichimoku", "vwmacd", "stats", "tail_risk", "ml", "extra"]
# Members of sets that are joined to the table instead of resolved by the registry.
ADF_SET, WAVELET_SET = "risk", "ml"


def build_features(
    bars: DataFrame,
    bar_seconds: int,
    sets: list[str] = STANDARD_SETS,
    quotes: DataFrame | None = None,
    market: DataFrame | None = None,
    adf: bool | None = None,
    wavelet: bool | None = None,
    check: bool = True,
    complete: bool = True,
    names: list[str] | None = None,
) -> DataFrame:
    """Validated bars with the columns of the sets, or with the named features.

    quotes: adds bid, ask, last_price. market: adds beta and market_correlation; without it
    those columns do not exist. adf, wavelet: whether adf_stat_30 and wavelet_coeff are added; by
    default where their sets (risk and ml) are asked for.
    complete: keep only rows without a missing value.
    """
    if check:
        bars, _ = validate(bars)
    asked = sets if names is None else []
    adf = ADF_SET in asked if adf is None else adf
    wavelet = WAVELET_SET in asked if wavelet is None else wavelet
    names = set_columns(sets) if names is None else list(names)
    if market is not None and "log_ret" not in names:
        names.append("log_ret")
    table = features(bars, names, bar_seconds)
    if market is not None or adf or wavelet:
        table = stage(table, "features")
    if market is not None:
        table = add_market_risk(table, market, bar_seconds)
    if adf:
        table = table.join(rolling_adf(bars, bar_seconds), ["symbol", "time"], "left")
    if wavelet:
        column = wavelet_coeff(bars.select("symbol", "time", "close"), bar_seconds)
        table = table.join(column.drop("close"), ["symbol", "time"])
    if quotes is not None:
        table = add_quotes(table, quotes)
    return table.na.drop("any") if complete else table


def model_table(
    bars: DataFrame, bar_seconds: int, quotes: DataFrame, market: DataFrame, adf: bool = True
) -> DataFrame:
    """Bars with every feature the model may use; missing values stay for the imputer."""
    joined = {"bid", "ask", "last_price"}
    names = [n for n in MODEL_FEATURES if n not in bars.columns and n not in joined and resolve(n)]
    return build_features(bars, bar_seconds, names=names, quotes=quotes, market=market, adf=adf, complete=False)


def run_features(
    spark: SparkSession,
    source: str,
    target: str,
    timeframe: str,
    bar_seconds: int,
    symbols: list[str] | None = None,
    num_candles: int | None = None,
    frame_period: int | None = None,
    format: str = "parquet",
    **options,
) -> None:
    """Read bars, keep the newest ones, build the features and write one table for all symbols."""
    bars = read_bars(spark, source, format, symbols, num_candles, bar_seconds)
    if frame_period is not None:
        bars = last_rows(bars, frame_period, bar_seconds)
    write_bars(build_features(bars, bar_seconds, **options), target, timeframe, format)
