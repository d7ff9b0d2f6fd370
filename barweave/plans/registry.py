"""What every feature column is: its inputs and its expression.

A feature is either an expression (possibly over ordered windows) of other columns, looking
`back` rows, or a `Scan`. Names carry their period (`sma_9`, `rsi_14`); `resolve` finds the rule.
Names that start with an underscore are intermediate columns.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from barweave.functions import rolling as R
from barweave.functions.rolling import Frame, positive, ratio
from barweave.operators.scan import Scan, ema, wilder

C = F.col


def q(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass(frozen=True)
class Feature:
    name: str
    needs: tuple[str, ...]
    make: Callable[[Frame], Column] | None = None
    back: int = 0
    windowed: bool = False
    scan: Scan | None = None


_FIXED: dict[str, Feature] = {}
_FAMILIES: list[tuple[re.Pattern, Callable[..., Feature]]] = []


def _row(name: str, needs: str, make: Callable[[], Column]) -> None:
    _FIXED[name] = Feature(name, tuple(needs.split()), lambda w: make())


def _win(name: str, needs: str, back: int, make: Callable[[Frame], Column]) -> None:
    _FIXED[name] = Feature(name, tuple(needs.split()), make, back, True)


def _scan(name: str, scan: Scan) -> None:
    _FIXED[name] = Feature(name, (scan.x,), scan=scan)


def _family(pattern: str):
    def register(build: Callable[..., Feature]):
        _FAMILIES.append((re.compile(pattern), build))
        return build

    return register


def resolve(name: str) -> Feature | None:
    """The rule of a feature name, or None for an input column."""
    if name in _FIXED:
        return _FIXED[name]
    for pattern, build in _FAMILIES:
        found = pattern.fullmatch(name)
        if found:
            return build(name, *[int(g) if g.isdigit() else g for g in found.groups()])
    return None


def _totals(*columns: str) -> tuple[str, ...]:
    """The running totals `Frame.span` works on."""
    return tuple(f"_{kind}[{c}]" for c in columns for kind in ("run", "num"))


@_family(r"_run\[(.+)\]")
def _run(name, x):
    return Feature(name, (x,), lambda w: F.sum(q(x)).over(w.running), 0, True)


@_family(r"_num\[(.+)\]")
def _num(name, x):
    return Feature(name, (x,), lambda w: F.count(q(x)).over(w.running), 0, True)


# --- prices ---------------------------------------------------------------------------------

_row("volatility", "high low", lambda: C("high") - C("low"))
_row("change_percent", "open close", lambda: ratio(C("close") - C("open"), C("open")) * 100)
_row("avg_price", "open high low close", lambda: (C("open") + C("high") + C("low") + C("close")) / 4)
_row("last_price", "bid ask", lambda: (C("bid") + C("ask")) / 2)
_row("_tp", "high low close", lambda: (C("high") + C("low") + C("close")) / 3)
_win("_prev", "close", 1, lambda w: w.lag("close"))
_row("log_ret", "close _prev", lambda: F.when((C("close") > 0) & (C("_prev") > 0), F.ln(C("close") / C("_prev"))))
_row("current_return", "close _prev", lambda: ratio(C("close"), C("_prev")) - 1)
_row("_change", "close _prev", lambda: C("close") - C("_prev"))


@_family(r"(open|high|low|close)_lag(\d+)")
def _lag(name, column, i):
    return Feature(name, (column,), lambda w: w.lag(column, i), i, True)


# --- moving averages ------------------------------------------------------------------------


def sma_of(column: str, n: int, name: str) -> Feature:
    return Feature(name, _totals(column), lambda w: w.span(column, n) / n, n - 1, True)


def ema_of(column: str, n: int, name: str) -> Feature:
    return Feature(name, (column,), scan=ema(column, n))


@_family(r"sma_(\d+)")
def _sma(name, n):
    return sma_of("close", n, name)


@_family(r"ema_(\d+)")
def _ema(name, n):
    return ema_of("close", n, name)


_win("_place", "rn", 0, lambda w: F.row_number().over(w.ordered))


@_family(r"wma_(\d+)")
def _wma(name, n):
    return Feature(name, ("close", "_place"), lambda w: w.weighted(C("close"), n), n - 1, True)


@_family(r"_hull_(\d+)")
def _hull(name, n):
    return Feature(name, (f"wma_{n // 2}", f"wma_{n}"), lambda w: 2 * C(f"wma_{n // 2}") - C(f"wma_{n}"))


@_family(r"hma_(\d+)")
def _hma(name, n):
    x, m = f"_hull_{n}", math.isqrt(n)
    return Feature(name, (x, "_place"), lambda w: w.weighted(C(x), m), m - 1, True)


_scan("ewma_30", Scan("close", lam=29 / 31, gain=2 / 31))
_scan("_ewm_volatility", Scan("volatility", lam=29 / 31, gain=1.0))


def _vol_cluster():
    weights = (1 - F.pow(F.lit(29 / 31), C("rn") + 1)) / F.lit(1 - 29 / 31)
    mean = C("_ewm_volatility") / weights
    # A first or constant value equals its own mean; rounding must not tell them apart.
    return (C("volatility") - mean > 1e-12 * mean).cast("int")


_row("vol_cluster", "volatility _ewm_volatility rn", _vol_cluster)


@_family(r"bb_(upper|lower)(\d+)")
def _band(name, side, n):
    sign = 2 if side == "upper" else -2
    return Feature(
        name, ("close",), lambda w: w.mean(C("close"), n) + sign * w.std_pop(C("close"), n), n - 1, True
    )


_row("bb_width", "bb_upper20 bb_lower20", lambda: C("bb_upper20") - C("bb_lower20"))
_row(
    "bollinger_percent_b",
    "close bb_upper20 bb_lower20",
    lambda: ratio(C("close") - C("bb_lower20"), C("bb_upper20") - C("bb_lower20")),
)
_row("keltner_upper", "ema_20 atr_14", lambda: C("ema_20") + 2 * C("atr_14"))
_row("keltner_lower", "ema_20 atr_14", lambda: C("ema_20") - 2 * C("atr_14"))
_row(
    "keltner_break",
    "close keltner_upper keltner_lower",
    lambda: F.when(C("close") > C("keltner_upper"), 1).when(C("close") < C("keltner_lower"), -1).otherwise(0),
)


@_family(r"_middle_(\d+)")
def _middle(name, n):
    return Feature(
        name, ("high", "low"), lambda w: (w.max(C("high"), n) + w.min(C("low"), n)) / 2, n - 1, True
    )


_row("ichi_conversion", "_middle_9", lambda: C("_middle_9"))
_row("ichi_base", "_middle_26", lambda: C("_middle_26"))
_row("ichi_leading_span_a", "_middle_9 _middle_26", lambda: (C("_middle_9") + C("_middle_26")) / 2)
_row("ichi_leading_span_b", "_middle_52", lambda: C("_middle_52"))

_row("_cv", "close tick_volume", lambda: C("close") * C("tick_volume"))
_scan("_cum_cv", Scan("_cv", kind="sum"))
_scan("_cum_v", Scan("tick_volume", kind="sum"))
_row("vwap", "_cum_cv _cum_v", lambda: ratio(C("_cum_cv"), C("_cum_v")))


@_family(r"vwap_(\d+)")
def _vwap(name, n):
    return Feature(
        name,
        _totals("_cv", "tick_volume"),
        lambda w: ratio(w.span("_cv", n), w.span("tick_volume", n)),
        n - 1,
        True,
    )


@_family(r"rolling_(max|min)_(\d+)")
def _extreme(name, side, n):
    return Feature(name, ("close",), lambda w: getattr(w, side)(C("close"), n), n - 1, True)


@_family(r"sma_diff_(\d+)_(\d+)")
def _diff(name, a, b):
    return Feature(name, (f"sma_{a}", f"sma_{b}"), lambda w: C(f"sma_{a}") - C(f"sma_{b}"))


@_family(r"_side_(\d+)_(\d+)")
def _side(name, a, b):
    # A missing difference counts as below.
    return Feature(name, (f"sma_diff_{a}_{b}",), lambda w: F.when(C(f"sma_diff_{a}_{b}") > 0, 1).otherwise(-1))


@_family(r"sma_cross_signal_(\d+)_(\d+)")
def _cross(name, a, b):
    x = f"_side_{a}_{b}"
    return Feature(name, (x,), lambda w: C(x) - w.lag(x), 1, True)


# --- dispersion -----------------------------------------------------------------------------

_row(
    "TR",
    "high low _prev",
    lambda: F.greatest(C("high") - C("low"), F.abs(C("high") - C("_prev")), F.abs(C("low") - C("_prev"))),
)


@_family(r"atr_(\d+)")
def _atr(name, n):
    return Feature(name, ("TR",), scan=wilder("TR", n))


@_family(r"(?:std_dev|rolling_volatility)_(\d+)")
def _std(name, n):
    return Feature(name, ("close",), lambda w: w.std(C("close"), n), n - 1, True)


@_family(r"volatility_(\d+)")
def _vol(name, n):
    return Feature(name, ("log_ret",), lambda w: w.std(C("log_ret"), n), n - 1, True)


_win(
    "zscore_vol",
    "volatility",
    49,
    lambda w: ratio(C("volatility") - w.mean(C("volatility"), 50), w.std_pop(C("volatility"), 50)),
)
_win(
    "volatility_regime",
    "volatility",
    49,
    lambda w: F.when(C("volatility") > w.mean(C("volatility"), 50), 1).otherwise(-1),
)
_row("trend_strength", "adx_14", lambda: C("adx_14"))

# --- momentum -------------------------------------------------------------------------------

_row("_gain", "_change", lambda: positive(C("_change")))
_row("_loss", "_change", lambda: positive(-C("_change")))


@_family(r"_(gain|loss)_(\d+)")
def _wilder_change(name, side, n):
    return Feature(name, (f"_{side}",), scan=wilder(f"_{side}", n))


@_family(r"rsi_(\d+)")
def _rsi(name, n):
    up, down = C(f"_gain_{n}"), C(f"_loss_{n}")
    value = F.when(up + down == 0, 0.0).otherwise(100 * ratio(up, up + down))
    return Feature(name, (f"_gain_{n}", f"_loss_{n}"), lambda w: F.when(up.isNotNull(), value))


@_family(r"cmo_(\d+)")
def _cmo(name, n):
    up, down = C(f"_gain_{n}"), C(f"_loss_{n}")
    value = F.when(up + down == 0, 0.0).otherwise(100 * ratio(up - down, up + down))
    return Feature(name, (f"_gain_{n}", f"_loss_{n}"), lambda w: F.when(up.isNotNull(), value))


# Both MACD averages start on row 25: the fast one is seeded by rows 14..25.
for _prefix, _x in (("macd", "close"), ("vwmacd", "vwap")):
    _scan(f"_{_prefix}_fast", Scan(_x, lam=11 / 13, gain=2 / 13, seed_from=14, seed_at=25))
    _scan(f"_{_prefix}_slow", ema(_x, 26))
    _row(
        f"_{_prefix}_line",
        f"_{_prefix}_fast _{_prefix}_slow",
        lambda p=_prefix: C(f"_{p}_fast") - C(f"_{p}_slow"),
    )
    _scan(f"{_prefix}_signal", ema(f"_{_prefix}_line", 9, first=25))
    _row(
        _prefix,
        f"_{_prefix}_line rn",
        lambda p=_prefix: F.when(C("rn") >= 33, C(f"_{p}_line")),
    )
_row("signal_macd", "macd_signal", lambda: C("macd_signal"))
_row("macd_hist", "macd macd_signal", lambda: C("macd") - C("macd_signal"))


@_family(r"roc_(\d+)")
def _roc(name, n):
    return Feature(name, ("close",), lambda w: (ratio(C("close"), w.lag("close", n)) - 1) * 100, n, True)


@_family(r"momentum_(\d+)")
def _momentum(name, n):
    return Feature(name, ("close",), lambda w: C("close") - w.lag("close", n), n, True)


@_family(r"williams_r_(\d+)")
def _williams(name, n):
    def make(w):
        top, bottom = w.max(C("high"), n), w.min(C("low"), n)
        return F.when(top == bottom, 0.0).otherwise(-100 * ratio(top - C("close"), top - bottom))

    return Feature(name, ("high", "low", "close"), make, n - 1, True)


def _fast_k(w):
    top, bottom = w.max(C("high"), 14), w.min(C("low"), 14)
    return F.when(top == bottom, 0.0).otherwise(100 * ratio(C("close") - bottom, top - bottom))


_win("_fast_k", "high low close", 13, _fast_k)
_win("_slow_k", "_fast_k", 2, lambda w: w.mean(C("_fast_k"), 3))
_win("stoch_d", "_slow_k", 2, lambda w: w.mean(C("_slow_k"), 3))
_row("stoch_k", "_slow_k rn", lambda: F.when(C("rn") >= 17, C("_slow_k")))


@_family(r"_tp_mean_(\d+)")
def _tp_mean(name, n):
    return sma_of("_tp", n, name)


@_family(r"cci_(\d+)")
def _cci(name, n):
    centre = C(f"_tp_mean_{n}")
    gap = C("_tp") - centre

    def make(w):
        spread = w.rows(C("_tp"), n, lambda v: R.mean_gap(v, centre, n))
        return F.when((gap == 0) | (spread == 0), 0.0).otherwise(ratio(gap, 0.015 * spread))

    return Feature(name, ("_tp", f"_tp_mean_{n}"), make, n - 1, True)


_win("_up_move", "high", 1, lambda w: C("high") - w.lag("high"))
_win("_down_move", "low", 1, lambda w: w.lag("low") - C("low"))
_row(
    "_plus_move",
    "_up_move _down_move",
    lambda: F.when((C("_up_move") > C("_down_move")) & (C("_up_move") > 0), C("_up_move")).otherwise(0.0),
)
_row(
    "_minus_move",
    "_up_move _down_move",
    lambda: F.when((C("_down_move") > C("_up_move")) & (C("_down_move") > 0), C("_down_move")).otherwise(0.0),
)


@_family(r"_smooth_(plus_move|minus_move)_(\d+)")
def _smooth(name, x, n):
    scan = Scan(f"_{x}", lam=(n - 1) / n, gain=1.0, seed_from=1, seed_at=n - 1, seed="sum")
    return Feature(name, (scan.x,), scan=scan)


@_family(r"_dx_(\d+)")
def _dx(name, n):
    # The smoothed range cancels out of the quotient; no movement counts as no trend.
    plus, minus = C(f"_smooth_plus_move_{n}"), C(f"_smooth_minus_move_{n}")
    return Feature(
        name,
        (f"_smooth_plus_move_{n}", f"_smooth_minus_move_{n}"),
        lambda w: F.coalesce(100 * ratio(F.abs(plus - minus), plus + minus), F.lit(0.0)),
    )


@_family(r"adx_(\d+)")
def _adx(name, n):
    return Feature(name, (f"_dx_{n}",), scan=wilder(f"_dx_{n}", n, first=n))


# Range sums over plain moves; the first row counts as no move.
_row("+DM", "_up_move", lambda: F.when(C("_up_move") > 0, C("_up_move")).otherwise(0.0))
_row("-DM", "_down_move", lambda: F.when(C("_down_move") > 0, C("_down_move")).otherwise(0.0))
for _name in ("+DM", "-DM", "TR"):
    _win(f"{_name}_sum", " ".join(_totals(_name)), 13, lambda w, x=_name: w.span(x, 14))
for _name in ("+", "-"):
    _row(
        f"{_name}VI",
        f"{_name}DM_sum TR_sum",
        lambda x=_name: ratio(q(f"{x}DM_sum"), C("TR_sum")) * 100,
    )
_row("bull_power", "high ema_13", lambda: C("high") - C("ema_13"))
_row("bear_power", "low ema_13", lambda: C("low") - C("ema_13"))

# --- volume ---------------------------------------------------------------------------------

_row(
    "_signed_volume",
    "_change tick_volume",
    lambda: F.when(C("_change") < 0, -C("tick_volume"))
    .when(C("_change") == 0, F.lit(0))
    .otherwise(C("tick_volume"))
    .cast("double"),
)
_scan("obv", Scan("_signed_volume", kind="sum"))


@_family(r"obv_(\d+)")
def _obv_mean(name, n):
    return sma_of("obv", n, name)


_win("_prev_tp", "_tp", 1, lambda w: w.lag("_tp"))
for _name, _op in (("_flow_up", "gt"), ("_flow_down", "lt")):
    _row(
        _name,
        "_tp _prev_tp tick_volume",
        lambda up=_op == "gt": F.when(
            (C("_tp") > C("_prev_tp")) if up else (C("_tp") < C("_prev_tp")), C("_tp") * C("tick_volume")
        ).when(C("_prev_tp").isNotNull(), 0.0),
    )


@_family(r"mfi_(\d+)")
def _mfi(name, n):
    def make(w):
        up, down = w.span("_flow_up", n), w.span("_flow_down", n)
        return F.when(up + down < 1, 0.0).otherwise(100 * ratio(up, up + down))

    return Feature(name, _totals("_flow_up", "_flow_down"), make, n - 1, True)


_row(
    "_flow",
    "high low close tick_volume",
    lambda: F.coalesce(
        ratio((C("close") - C("low")) - (C("high") - C("close")), C("high") - C("low")), F.lit(0.0)
    )
    * C("tick_volume"),
)


@_family(r"cmf_(\d+)")
def _cmf(name, n):
    return Feature(
        name,
        _totals("_flow", "tick_volume"),
        lambda w: ratio(w.span("_flow", n), w.span("tick_volume", n)),
        n - 1,
        True,
    )


@_family(r"vroc_(\d+)")
def _vroc(name, n):
    return Feature(
        name, ("tick_volume",), lambda w: (ratio(C("tick_volume"), w.lag("tick_volume", n)) - 1) * 100, n, True
    )


_row("volume_profile", "tick_volume high low", lambda: C("tick_volume") * (C("high") - C("low")))
_scan("_ad_line", Scan("_flow", kind="sum"))
# Both averages start from the first value of the line.
_scan("_ad_fast", Scan("_ad_line", lam=2 / 4, gain=2 / 4))
_scan("_ad_slow", Scan("_ad_line", lam=9 / 11, gain=2 / 11))
_row("adl", "_ad_fast _ad_slow rn", lambda: F.when(C("rn") >= 9, C("_ad_fast") - C("_ad_slow")))
_win(
    "vw_rsi",
    "rsi_14 tick_volume " + " ".join(_totals("tick_volume")),
    13,
    lambda w: ratio(C("rsi_14") * C("tick_volume"), w.span("tick_volume", 14) / 14),
)
_win("volume_skew", "tick_volume", 29, lambda w: w.skew(C("tick_volume"), 30))
_win("volume_kurtosis", "tick_volume", 29, lambda w: w.kurt(C("tick_volume"), 30))

# --- statistics and risk --------------------------------------------------------------------


def _tail_mean(v):
    ordered = F.sort_array(v)
    return R.mean_up_to(ordered, R.sorted_quantile(ordered, 100, 0.05))


_win("es_95", "log_ret", 99, lambda w: w.rows(C("log_ret"), 100, _tail_mean))
_win("var_95", "log_ret", 19, lambda w: w.quantile(C("log_ret"), 20, 0.05))


_row("_won", "log_ret", lambda: positive(C("log_ret")))
_row("_lost", "log_ret", lambda: positive(-C("log_ret")))
_win(
    "omega_ratio",
    " ".join(_totals("_won", "_lost")),
    29,
    lambda w: ratio(w.span("_won", 30), w.span("_lost", 30)),
)
_scan("cum_max", Scan("close", kind="max"))
_row("drawdown", "cum_max close", lambda: ratio(C("cum_max") - C("close"), C("cum_max")))
_row("max_drawdown", "cum_max close", lambda: C("cum_max") - C("close"))


_row("_squared_drawdown", "max_drawdown", lambda: C("max_drawdown") * C("max_drawdown"))


@_family(r"_depth_(\d+)")
def _depth(name, n):
    return sma_of("_squared_drawdown", n, name)


@_family(r"_ulcer_(\d+)")
def _ulcer(name, n):
    x = C(f"_depth_{n}")
    return Feature(name, (f"_depth_{n}",), lambda w: F.sqrt(F.when(x < 0, 0.0).otherwise(x)))


_row("ulcer_index", "_ulcer_252", lambda: C("_ulcer_252"))
HURST_LAGS = list(range(2, 20))


@_family(r"_step_(\d+)")
def _step(name, n):
    return Feature(name, ("close",), lambda w: C("close") - w.lag("close", n), n, True)


@_family(r"_spread_(\d+)")
def _spread(name, lag):
    # The differences of lag L inside a 30-row window are those of its last 30 - L rows. Their spread is not taken from
    # running totals: along a smooth trend it is far smaller than the differences.
    x = f"_step_{lag}"
    return Feature(name, (x,), lambda w: F.var_pop(C(x)).over(w.last(30 - lag)), 29 - lag, True)


def _hurst():
    result = F.when(C("_complete_30"), F.lit(0.0))
    for lag, weight in zip(HURST_LAGS, R.log_slope_weights(HURST_LAGS)):
        spread = C(f"_spread_{lag}")
        result = result + F.when(spread > 0, F.ln(spread)) * weight
    return result


_win("_complete_30", "_num[close]", 29, lambda w: w.present("close", 30))
_row("hurst_30", "_complete_30 " + " ".join(f"_spread_{lag}" for lag in HURST_LAGS), _hurst)


def _dickey_fuller(w):
    n, frame = 29, w.last(29)
    d, x = C("_change"), C("_prev")
    sxx, syy, sxy = F.regr_sxx(d, x).over(frame), F.regr_syy(d, x).over(frame), F.regr_sxy(d, x).over(frame)
    slope = ratio(sxy, sxx)
    variance = ratio((syy - slope * sxy) / (n - 2), sxx)
    return F.when(F.count(d).over(frame) == n, F.when(variance > 0, ratio(slope, F.sqrt(variance))))


_win("df_stat_30", "_change _prev", 28, _dickey_fuller)
_win(
    "sharpe_ratio",
    "log_ret",
    29,
    lambda w: ratio(w.mean(C("log_ret"), 30), w.std(C("log_ret"), 30)),
)


def _sortino(w):
    r = C("log_ret")
    below = F.stddev_samp(F.when(r < 0, r)).over(w.last(30))
    return ratio(w.mean(r, 30), below)


_win("sortino_ratio", "log_ret", 29, _sortino)
_win("returns_skewness", "log_ret", 29, lambda w: w.skew(C("log_ret"), 30))
_win("returns_kurtosis", "log_ret", 29, lambda w: w.kurt(C("log_ret"), 30))
_win("haar_approx", "close _prev", 0, lambda w: (C("_prev") + C("close")) / F.lit(math.sqrt(2)))
_win("haar_detail", "close _prev", 0, lambda w: (C("_prev") - C("close")) / F.lit(math.sqrt(2)))

# --- named sets -----------------------------------------------------------------------------

# The columns of each set.
SETS: dict[str, list[str]] = {
    "core": """volatility change_percent avg_price sma_5 sma_9 sma_21 sma_50 sma_100 sma_200
        ema_5 ema_9 ema_21 ema_50 ema_100 ema_200 rsi_14 rsi_9 macd signal_macd
        bb_upper21 bb_lower21 bb_upper9 bb_lower9 bb_upper50 bb_lower50 atr_14 roc_10 obv mfi_14
        rolling_max_20 rolling_min_20 std_dev_20 adx_14 vwap obv_10 obv_20 obv_50 obv_100""".split(),
    "ichimoku": "ichi_conversion ichi_base ichi_leading_span_a ichi_leading_span_b".split(),
    "vwmacd": "vwmacd vwmacd_signal".split(),
    "market_regime": "trend_strength volatility_regime".split(),
    "basic": "volatility change_percent avg_price log_ret zscore_vol".split(),
    "stats": "volume_skew volume_kurtosis hurst_30".split(),
    "ml": "vol_cluster haar_approx haar_detail".split(),
    "tail_risk": "es_95 omega_ratio".split(),
    "moving_averages": "sma_9 sma_21 sma_50 sma_100 sma_200".split(),
    "dynamic": "sma_9 sma_21 sma_50 rsi_14".split(),
    "volatility": """atr_14 atr_50 rolling_volatility_20 bb_width bollinger_percent_b ema_20
        keltner_upper keltner_lower keltner_break""".split(),
    "momentum": """roc_5 roc_20 williams_r_14 momentum_10 rsi_14 macd macd_signal macd_hist stoch_k
        stoch_d adx_14 cci_14 cmo_14 TR +DM -DM +DM_sum -DM_sum TR_sum +VI -VI ema_13 bull_power
        bear_power""".split(),
    "volume": "cmf_20 mfi_10 vwap_20 obv vroc_14 volume_profile adl vw_rsi".split(),
    "crossover": """sma_diff_50_200 sma_cross_signal_50_200 sma_diff_9_21
        sma_cross_signal_9_21""".split(),
    "lags": [f"{c}_lag{i}" for i in (1, 2, 3) for c in ("low", "high", "open", "close")],
    "hull": "hma_9 hma_14 hma_21 hma_50 hma_100".split(),
    "risk": "cum_max drawdown var_95 df_stat_30".split(),
    "extra": """log_ret max_drawdown volatility_30 sharpe_ratio sortino_ratio ewma_30
        returns_skewness returns_kurtosis ulcer_index""".split(),
}


def set_columns(names: list[str]) -> list[str]:
    """Columns of several sets, each once, in order."""
    return list(dict.fromkeys(c for name in names for c in SETS[name]))
