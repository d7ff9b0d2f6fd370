"""Schemas, fixed names and default parameters."""

from __future__ import annotations

from pyspark.sql import types as T

BAR = T.StructType(
    [
        T.StructField("symbol", T.StringType(), False),
        T.StructField("time", T.TimestampType(), False),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("tick_volume", T.LongType()),
        T.StructField("spread", T.DoubleType()),
    ]
)

TICK = T.StructType(
    [
        T.StructField("event_id", T.LongType(), False),
        T.StructField("ts", T.TimestampType(), False),
        T.StructField("symbol", T.StringType(), False),
        T.StructField("price", T.DoubleType()),
    ]
)

# Default parameters of training, back-test and live operation.
SPREAD = 0.025
TRADE_VALUE = 100.0
LIVE_TRADE_VALUE = 10.0
LEVERAGE = 200.0
CAPITAL = 1000.0
HORIZON = 9
THRESHOLD = 0.0035
IMPORTANCE_LIMIT = 0.0
IMPORTANCE_SWEEP = [-0.0005, 0.0, 0.0005, 0.001, 0.002]
TIME_ZONE = "America/Sao_Paulo"
SESSION_START = "00:00:00"
SESSION_END = "19:55:00"
CLOSE_AT = "17:55:00"

# State names of the trade ledger.
FLAT = "Sem Operação"
OPEN_LONG = "Compra"
OPEN_SHORT = "Venda"
HOLD_LONG = "Comprado"
HOLD_SHORT = "Vendido"
CLOSE_LONG = "Reversão Long"
CLOSE_SHORT = "Reversão Short"
CLOSE_TIME = "Fechado Horário"
CLOSED = [CLOSE_TIME, CLOSE_LONG, CLOSE_SHORT]

# The model's feature columns.
MODEL_FEATURES = [
    "+DM", "+DM_sum", "-DM", "-DM_sum", "adl", "adf_stat_30", "ask", "atr_14", "atr_50", "avg_price", "bear_power",
    "beta", "bid", "bollinger_percent_b", "bull_power", "cci_14", "change_percent", "cmf_20", "close",
    "close_lag1", "close_lag2", "close_lag3", "cum_max", "drawdown", "ema_13", "ema_20", "ewma_30", "high", "high_lag1",
    "high_lag2", "high_lag3", "hma_14", "hma_50", "last_price", "low", "low_lag1", "low_lag2", "low_lag3", "log_ret", "macd",
    "macd_hist", "macd_signal", "momentum_10", "mfi_10", "open", "open_lag1", "open_lag2", "open_lag3", "obv", "roc_20",
    "roc_5", "rsi_14", "sharpe_ratio", "sma_100", "sma_200", "sma_21", "sma_50", "sma_9", "sma_cross_signal_50_200",
    "sma_cross_signal_9_21", "sma_diff_50_200", "sma_diff_9_21", "spread", "stoch_d", "stoch_k", "tick_volume",
    "TR_sum", "ulcer_index", "vwap_20", "volume_profile", "vw_rsi", "vroc_14", "williams_r_14", "zscore_vol",
]
