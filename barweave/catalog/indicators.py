"""Feature queries: one per indicator, all over hourly bars of the whole event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from barweave.catalog.tables import HOUR, MARKET, PLAIN, bars, feature_query, query, rounded, shown, ticks
from barweave.operators.blocks import number_rows
from barweave.operators.market import add_market_risk
from barweave.operators.unit_root import rolling_adf
from barweave.operators.wavelet import wavelet_coeff
from barweave.plans.divergence import macd_divergence
from barweave.plans.features import add_quotes, dynamic, features, moving_average
from barweave.plans.registry import SETS, set_columns
from barweave.sources.bars import latest_quotes, market_returns

feature_query("price_features", "volatility change_percent avg_price volume_profile")
feature_query("returns", "log_ret current_return")
feature_query("volume_rate_of_change", "vroc_14")
feature_query("lags", " ".join(SETS["lags"]))
feature_query("sma", "sma_5 sma_9 sma_21 sma_50 sma_100 sma_200")
feature_query("ema", "ema_5 ema_9 ema_13 ema_20 ema_21 ema_50 ema_100 ema_200")
feature_query("wma", "wma_9 wma_21")
feature_query("hull", "hma_9 hma_14 hma_21 hma_50 hma_100")
feature_query("ewma", "ewma_30")
feature_query("volatility_cluster", "vol_cluster")
feature_query("bollinger", "bb_upper21 bb_lower21 bb_upper9 bb_lower9 bb_upper50 bb_lower50")
feature_query("bollinger_width", "bb_width bollinger_percent_b")
feature_query("keltner", "keltner_upper keltner_lower keltner_break")
feature_query("ichimoku", "ichi_conversion ichi_base ichi_leading_span_a ichi_leading_span_b")
feature_query("vwap", "vwap")
feature_query("vwap_rolling", "vwap_20")
feature_query("rolling_extremes", "rolling_max_20 rolling_min_20")
feature_query("sma_difference", "sma_diff_9_21 sma_diff_50_200")
feature_query("sma_crossing", "sma_cross_signal_9_21 sma_cross_signal_50_200")
feature_query("true_range", "TR")
feature_query("atr", "atr_14 atr_50")
feature_query("rolling_deviation", "std_dev_20 rolling_volatility_20")
feature_query("return_volatility", "volatility_30")
feature_query("zscore_volatility", "zscore_vol")
feature_query("volatility_regime", "volatility_regime")
feature_query("trend_strength", "trend_strength")
feature_query("rsi", "rsi_14 rsi_9")
feature_query("macd", "macd macd_signal macd_hist")
feature_query("vwmacd", "vwmacd vwmacd_signal")
feature_query("roc", "roc_5 roc_10 roc_20")
feature_query("momentum", "momentum_10")
feature_query("williams_r", "williams_r_14")
feature_query("stochastic", "stoch_k stoch_d")
feature_query("cci", "cci_14")
feature_query("adx", "adx_14")
feature_query("cmo", "cmo_14")
feature_query("vortex", "+DM -DM +DM_sum -DM_sum TR_sum +VI -VI")
feature_query("elder_ray", "bull_power bear_power")
feature_query("obv", "obv")
feature_query("obv_means", "obv_10 obv_20 obv_50 obv_100")
feature_query("mfi", "mfi_14 mfi_10")
feature_query("cmf", "cmf_20")
feature_query("chaikin_oscillator", "adl")
feature_query("volume_rsi", "vw_rsi")
feature_query("volume_moments", "volume_skew volume_kurtosis")
feature_query("expected_shortfall", "es_95")
feature_query("value_at_risk", "var_95")
feature_query("omega", "omega_ratio")
feature_query("drawdown", "cum_max drawdown max_drawdown")
feature_query("ulcer", "ulcer_index")
feature_query("hurst", "hurst_30")


@query("hurst_trend")
def _hurst_trend(spark, sf_dir):
    """A steep trend with very small deviations, whose spread is lost when large totals are subtracted."""
    table = number_rows(bars(spark, sf_dir), HOUR)
    close = 50000 + 3.0 * F.col("rn") + 1e-6 * (F.col("close") - F.floor("close"))
    return shown(features(table.withColumn("close", close), ["hurst_30"], HOUR), ["hurst_30"])


feature_query("dickey_fuller", "df_stat_30")
feature_query("sharpe", "sharpe_ratio")
feature_query("sortino", "sortino_ratio")
feature_query("return_moments", "returns_skewness returns_kurtosis")
feature_query("haar", "haar_approx haar_detail")


@query("moving_average")
def _moving_average(spark, sf_dir):
    sma = moving_average(bars(spark, sf_dir), "high", [7, 30], HOUR)
    both = moving_average(sma, "high", 7, HOUR, ma_type="EMA")
    return shown(both, ["sma_7", "sma_30", "ema_7"])


@query("dynamic_indicators")
def _dynamic(spark, sf_dir):
    table = dynamic(bars(spark, sf_dir), HOUR, sma_periods=[4, 12], rsi_period=10)
    return shown(table, ["sma_4", "sma_12", "rsi_10"])


@query("quotes_on_bars")
def _quotes(spark, sf_dir):
    table = add_quotes(bars(spark, sf_dir), latest_quotes(ticks(spark, sf_dir), 0.025))
    return shown(table, ["close", "bid", "ask", "last_price"])


@query("market_returns")
def _market_returns(spark, sf_dir):
    market = market_returns(bars(spark, sf_dir, market=MARKET), HOUR)
    return market.select(
        F.unix_timestamp("time").alias("time"), rounded("market_log_ret").alias("market_log_ret")
    )


@query("market_risk")
def _market_risk(spark, sf_dir):
    market = market_returns(bars(spark, sf_dir, market=MARKET), HOUR)
    table = add_market_risk(features(bars(spark, sf_dir), ["log_ret"], HOUR), market, HOUR)
    return shown(table, ["beta", "market_correlation"])


@query("macd_divergence")
def _macd_divergence(spark, sf_dir):
    return shown(macd_divergence(bars(spark, sf_dir), HOUR), ["macd_divergence"])


@query("wavelet")
def _wavelet(spark, sf_dir):
    return shown(wavelet_coeff(bars(spark, sf_dir), HOUR), ["wavelet_coeff"])


@query("augmented_dickey_fuller")
def _adf(spark, sf_dir):
    return shown(rolling_adf(bars(spark, sf_dir), HOUR), ["adf_stat_30"])


@query("complete_rows")
def _complete(spark, sf_dir):
    names = ["sma_21", "roc_10", "close_lag3"]
    return shown(features(bars(spark, sf_dir), names, HOUR).na.drop("any"), names)


@query("feature_pipeline")
def _pipeline(spark, sf_dir):
    from barweave.plans.job import build_features

    market = market_returns(bars(spark, sf_dir, market=MARKET), HOUR)
    table = build_features(
        bars(spark, sf_dir), HOUR, quotes=latest_quotes(ticks(spark, sf_dir), 0.025), market=market
    )
    return shown(table, [c for c in table.columns if c not in ("symbol", "time", "rn")], PLAIN)


@query("all_feature_sets")
def _all_sets(spark, sf_dir):
    names = set_columns(list(SETS))
    return shown(features(bars(spark, sf_dir), names, HOUR), names, PLAIN)
