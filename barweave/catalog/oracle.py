"""The same results as the catalog's queries in plain SQL, for checking.

Written for DuckDB: windows over a whole symbol and recursive tables that step bar by bar,
so it shares no method with the block-wise library.
"""

from __future__ import annotations

import re

HOUR = 3600
ORACLE: dict[str, str] = {}


def rounded(expression: str, name: str) -> str:
    """Six decimals and no negative zero; exact ties go up."""
    return f"round(CAST({expression} AS DOUBLE) + 3e-10, 6) + 0.0 AS {name}"


def bar_table(name: str, seconds: int = HOUR, symbol: str = "event_type") -> str:
    micros = seconds * 1_000_000
    return f"""{name} AS MATERIALIZED (
        SELECT {symbol} AS symbol, make_timestamp((epoch_us(ts) // {micros}) * {micros}) AS time,
            first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
            last(value ORDER BY ts, event_id) AS close, count(*)::BIGINT AS tick_volume
        FROM events GROUP BY 1, 2)"""


W = "(PARTITION BY symbol ORDER BY time)"

NUMBERED = f"""n AS MATERIALIZED (
        SELECT *, row_number() OVER {W} - 1 AS rn, lag(close) OVER {W} AS prev,
            lag(high) OVER {W} AS prev_high, lag(low) OVER {W} AS prev_low,
            (high + low + close) / 3 AS tp,
            greatest(high - low, abs(high - lag(close) OVER {W}), abs(low - lag(close) OVER {W})) AS tr,
            ln(close / lag(close) OVER {W}) AS r
        FROM bars)"""


def over(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY time ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


CUM = "OVER (PARTITION BY symbol ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def full(n: int, aggregate: str, present: str) -> str:
    """`aggregate` over n rows once all n are present."""
    return f"CASE WHEN count({present}) {over(n)} = {n} THEN {aggregate} {over(n)} END"


def mean(n: int, x: str) -> str:
    return full(n, f"avg({x})", x)


def recursion(name: str, source: str, start: int, first: dict[str, str], step: dict[str, str]) -> str:
    """Values per bar from the previous bar's values (p) and the bar's inputs (b)."""
    a = ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in first.items())
    s = ", ".join(f"CAST({step[c]} AS DOUBLE)" for c in first)
    return f"""{name} AS (
        SELECT symbol, rn, {a} FROM {source} WHERE rn = {start}
        UNION ALL
        SELECT b.symbol, b.rn, {s} FROM {name} p JOIN {source} b ON b.symbol = p.symbol AND b.rn = p.rn + 1)"""


def select(columns: dict[str, str], source: str = "n", tables: list[str] = (), where: str = "") -> str:
    """A query on numbered bars: symbol, time in epoch seconds, rounded columns."""
    parts = ",\n    ".join([bar_table("bars"), NUMBERED, *tables])
    shown = ", ".join(rounded(e, c) for c, e in columns.items())
    return f"""WITH RECURSIVE {parts}
    SELECT symbol, epoch(time)::BIGINT AS time, {shown} FROM {source} {where}"""


def joined(*names: str) -> str:
    """n with the recursive tables of those names on every bar."""
    return "n " + " ".join(f"LEFT JOIN {t} USING (symbol, rn)" for t in names)


def same(*names: str) -> dict[str, str]:
    return {c: c for c in names}


# --- plain and sliding columns --------------------------------------------------------------

ORACLE["price_features"] = select(
    {
        "volatility": "high - low",
        "change_percent": "(close - open) / open * 100",
        "avg_price": "(open + high + low + close) / 4",
        "volume_profile": "tick_volume * (high - low)",
    }
)
ORACLE["returns"] = select({"log_ret": "r", "current_return": "close / prev - 1"})
ORACLE["volume_rate_of_change"] = select({"vroc_14": f"(tick_volume / lag(tick_volume, 14) OVER {W} - 1) * 100"})
ORACLE["lags"] = select(
    {f"{c}_lag{i}": f"lag({c}, {i}) OVER {W}" for i in (1, 2, 3) for c in ("low", "high", "open", "close")}
)
ORACLE["sma"] = select({f"sma_{p}": mean(p, "close") for p in (5, 9, 21, 50, 100, 200)})


def wma(x: str, p: int) -> str:
    """Weights 1..p by position in the window's list."""
    items = f"list({x}) {over(p)}"
    dot = f"list_sum(list_transform({items}, lambda v, i: v * i))"
    return f"CASE WHEN count({x}) {over(p)} = {p} THEN {dot} / {p * (p + 1) / 2} END"


ORACLE["wma"] = select({f"wma_{p}": wma("close", p) for p in (9, 21)})

_HULL = {9: 3, 14: 3, 21: 4, 50: 7, 100: 10}
ORACLE["hull"] = select(
    {f"hma_{p}": wma(f"h{p}", m) for p, m in _HULL.items()},
    "h",
    [
        "h AS MATERIALIZED (SELECT symbol, time, rn, "
        + ", ".join(f"2 * ({wma('close', p // 2)}) - ({wma('close', p)}) AS h{p}" for p in _HULL)
        + " FROM n)"
    ],
)


def band(p: int, sign: str) -> str:
    return f"{mean(p, 'close')} {sign} 2 * {full(p, 'stddev_pop(close)', 'close')}"


ORACLE["bollinger"] = select(
    {f"bb_{side}{p}": band(p, sign) for p in (21, 9, 50) for side, sign in (("upper", "+"), ("lower", "-"))}
)
ORACLE["bollinger_width"] = select(
    {"bb_width": "u - l", "bollinger_percent_b": "(close - l) / nullif(u - l, 0)"},
    "b",
    [f"b AS (SELECT symbol, time, close, {band(20, '+')} AS u, {band(20, '-')} AS l FROM n)"],
)


def middle(p: int) -> str:
    return f"({full(p, 'max(high)', 'high')} + {full(p, 'min(low)', 'low')}) / 2"


ORACLE["ichimoku"] = select(
    {
        "ichi_conversion": middle(9),
        "ichi_base": middle(26),
        "ichi_leading_span_a": f"({middle(9)} + {middle(26)}) / 2",
        "ichi_leading_span_b": middle(52),
    }
)
ORACLE["vwap"] = select({"vwap": f"sum(close * tick_volume) {CUM} / sum(tick_volume) {CUM}"})
ORACLE["vwap_rolling"] = select(
    {"vwap_20": f"{full(20, 'sum(close * tick_volume)', 'close')} / sum(tick_volume) {over(20)}"}
)
ORACLE["rolling_extremes"] = select(
    {"rolling_max_20": full(20, "max(close)", "close"), "rolling_min_20": full(20, "min(close)", "close")}
)
_DIFFS = (
    f"d AS (SELECT *, {mean(9, 'close')} - {mean(21, 'close')} AS a, "
    f"{mean(50, 'close')} - {mean(200, 'close')} AS b FROM n)"
)
ORACLE["sma_difference"] = select({"sma_diff_9_21": "a", "sma_diff_50_200": "b"}, "d", [_DIFFS])
_CROSS = "c AS (SELECT *, CASE WHEN a > 0 THEN 1 ELSE -1 END AS sa, CASE WHEN b > 0 THEN 1 ELSE -1 END AS sb FROM d)"
ORACLE["sma_crossing"] = select(
    {"sma_cross_signal_9_21": f"sa - lag(sa) OVER {W}", "sma_cross_signal_50_200": f"sb - lag(sb) OVER {W}"},
    "c",
    [_DIFFS, _CROSS],
)
ORACLE["true_range"] = select({"tr": "tr"})
_STD20 = full(20, "stddev_samp(close)", "close")
ORACLE["rolling_deviation"] = select({"std_dev_20": _STD20, "rolling_volatility_20": _STD20})
ORACLE["return_volatility"] = select({"volatility_30": full(30, "stddev_samp(r)", "r")})
ORACLE["zscore_volatility"] = select(
    {
        "zscore_vol": f"((high - low) - {mean(50, '(high - low)')}) / "
        f"nullif({full(50, 'stddev_pop(high - low)', 'high')}, 0)"
    }
)
ORACLE["volatility_regime"] = select(
    {"volatility_regime": f"CASE WHEN high - low > {mean(50, '(high - low)')} THEN 1 ELSE -1 END"}
)
ORACLE["roc"] = select({f"roc_{p}": f"(close / lag(close, {p}) OVER {W} - 1) * 100" for p in (5, 10, 20)})
ORACLE["momentum"] = select({"momentum_10": f"close - lag(close, 10) OVER {W}"})
_HH, _LL = full(14, "max(high)", "high"), full(14, "min(low)", "low")
_RANGE = f"x AS (SELECT *, {_HH} AS hh, {_LL} AS ll FROM n)"
ORACLE["williams_r"] = select(
    {"williams_r_14": "CASE WHEN hh = ll THEN 0 ELSE -100 * (hh - close) / (hh - ll) END"}, "x", [_RANGE]
)
ORACLE["stochastic"] = select(
    {"stoch_k": "CASE WHEN rn >= 17 THEN k END", "stoch_d": mean(3, "k")},
    "k",
    [
        _RANGE,
        "f AS (SELECT *, CASE WHEN hh = ll THEN 0 ELSE 100 * (close - ll) / (hh - ll) END AS fk FROM x)",
        f"k AS (SELECT *, {mean(3, 'fk')} AS k FROM f)",
    ],
)
ORACLE["cci"] = select(
    {"cci_14": "CASE WHEN dev IS NULL THEN NULL WHEN dev = 0 OR tp = m THEN 0 ELSE (tp - m) / (0.015 * dev) END"},
    "d",
    [
        f"m AS (SELECT *, {mean(14, 'tp')} AS m, list(tp) {over(14)} AS tps FROM n)",
        "d AS (SELECT *, CASE WHEN m IS NOT NULL THEN list_avg(list_transform(tps, lambda v: abs(v - m))) END"
        " AS dev FROM m)",
    ],
)
ORACLE["vortex"] = select(
    {
        "plus_dm": "p",
        "minus_dm": "m",
        "plus_dm_sum": "ps",
        "minus_dm_sum": "ms",
        "tr_sum": "ts",
        "plus_vi": "ps / nullif(ts, 0) * 100",
        "minus_vi": "ms / nullif(ts, 0) * 100",
    },
    "s",
    [
        "d AS (SELECT *, greatest(coalesce(high - prev_high, 0), 0) AS p, "
        "greatest(coalesce(prev_low - low, 0), 0) AS m FROM n)",
        f"s AS (SELECT *, {full(14, 'sum(p)', 'p')} AS ps, {full(14, 'sum(m)', 'm')} AS ms, "
        f"{full(14, 'sum(tr)', 'tr')} AS ts FROM d)",
    ],
)
_SIGNED = "CASE WHEN close < prev THEN -tick_volume WHEN close = prev THEN 0 ELSE tick_volume END"
_OBV = [f"s AS (SELECT *, {_SIGNED} AS sv FROM n)", f"o AS (SELECT *, sum(sv) {CUM} AS obv FROM s)"]
ORACLE["obv"] = select({"obv": "obv"}, "o", _OBV)
ORACLE["obv_means"] = select({f"obv_{p}": mean(p, "obv") for p in (10, 20, 50, 100)}, "o", _OBV)
_FLOWS = [
    f"t AS (SELECT *, lag(tp) OVER {W} AS ptp FROM n)",
    "f AS (SELECT *, CASE WHEN ptp IS NULL THEN NULL WHEN tp > ptp THEN tp * tick_volume ELSE 0 END AS up, "
    "CASE WHEN ptp IS NULL THEN NULL WHEN tp < ptp THEN tp * tick_volume ELSE 0 END AS down FROM t)",
]


def money_flow(p: int) -> str:
    up, down = full(p, "sum(up)", "up"), full(p, "sum(down)", "down")
    return f"CASE WHEN {up} + {down} < 1 THEN 0 ELSE 100 * ({up}) / ({up} + {down}) END"


ORACLE["mfi"] = select({f"mfi_{p}": money_flow(p) for p in (14, 10)}, "f", _FLOWS)
_AD = "a AS MATERIALIZED (SELECT *, coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0) * tick_volume AS mf FROM n)"
ORACLE["cmf"] = select({"cmf_20": f"{full(20, 'sum(mf)', 'mf')} / sum(tick_volume) {over(20)}"}, "a", [_AD])
ORACLE["volume_moments"] = select(
    {
        "volume_skew": full(30, "skewness(tick_volume)", "tick_volume"),
        "volume_kurtosis": full(30, "kurtosis(tick_volume)", "tick_volume"),
    }
)
ORACLE["return_moments"] = select(
    {"returns_skewness": full(30, "skewness(r)", "r"), "returns_kurtosis": full(30, "kurtosis(r)", "r")}
)
ORACLE["expected_shortfall"] = select(
    {"es_95": "CASE WHEN c = 100 THEN list_avg(list_filter(rs, lambda v: v <= q)) END"},
    "e",
    [
        f"e AS (SELECT symbol, time, count(r) {over(100)} AS c, list(r) {over(100)} AS rs, "
        f"quantile_cont(r, 0.05) {over(100)} AS q FROM n)"
    ],
)
ORACLE["value_at_risk"] = select({"var_95": full(20, "quantile_cont(r, 0.05)", "r")})
ORACLE["omega"] = select(
    {
        "omega_ratio": f"CASE WHEN count(r) {over(30)} = 30 THEN sum(greatest(r, 0)) {over(30)} / "
        f"nullif(-sum(least(r, 0)) {over(30)}, 0) END"
    }
)
ORACLE["drawdown"] = select(
    {"cum_max": "cm", "drawdown": "(cm - close) / cm", "max_drawdown": "cm - close"},
    "d",
    [f"d AS (SELECT *, max(close) {CUM} AS cm FROM n)"],
)
ORACLE["ulcer"] = select(
    {"ulcer_index": f"sqrt({mean(252, '(cm - close) * (cm - close)')})"},
    "d",
    [f"d AS (SELECT *, max(close) {CUM} AS cm FROM n)"],
)
ORACLE["sharpe"] = select(
    {"sharpe_ratio": f"{mean(30, 'r')} / nullif({full(30, 'stddev_samp(r)', 'r')}, 0)"}
)
ORACLE["sortino"] = select(
    {"sortino_ratio": f"{mean(30, 'r')} / nullif(stddev_samp(CASE WHEN r < 0 THEN r END) {over(30)}, 0)"}
)
ORACLE["haar"] = select({"haar_approx": "(prev + close) / sqrt(2)", "haar_detail": "(prev - close) / sqrt(2)"})
ORACLE["dickey_fuller"] = select(
    {"df_stat_30": "CASE WHEN c = 29 THEN b / sqrt((syy - b * sxy) / 27 / sxx) END"},
    "s",
    [
        "d AS (SELECT *, close - prev AS d FROM n)",
        f"s AS (SELECT *, count(d) {over(29)} AS c, regr_slope(d, prev) {over(29)} AS b, "
        f"regr_syy(d, prev) {over(29)} AS syy, regr_sxy(d, prev) {over(29)} AS sxy, "
        f"regr_sxx(d, prev) {over(29)} AS sxx FROM d)",
    ],
)


def _hurst(source: str = "n") -> str:
    lags = "[" + ", ".join(str(i) for i in range(2, 20)) + "]"
    diffs = "list_transform(range(1, 31 - g), lambda i: xs[i + g] - xs[i])"
    return select(
        {"hurst_30": "2 * h"},
        "y",
        [
            f"w AS (SELECT symbol, time, rn, count(close) {over(30)} AS c, list(close) {over(30)} AS xs FROM {source})",
            f"g AS (SELECT symbol, time, rn, g, list_aggregate({diffs}, 'stddev_pop') AS s "
            f"FROM w, (SELECT unnest({lags}) AS g) WHERE c = 30)",
            "s AS (SELECT symbol, rn, regr_slope(ln(s), ln(g)) AS h FROM g GROUP BY ALL)",
            "y AS (SELECT n.symbol, n.time, s.h FROM n LEFT JOIN s USING (symbol, rn))",
        ],
    )


ORACLE["hurst"] = _hurst()
ORACLE["hurst_trend"] = _hurst("(SELECT * REPLACE (50000 + 3.0 * rn + 1e-6 * (close - floor(close)) AS close) FROM n)")

# --- recurrences ----------------------------------------------------------------------------


def averaged(x: str, frm: int, at: int) -> str:
    """Mean of x over rows frm..at, on row `at`."""
    return f"avg(CASE WHEN rn BETWEEN {frm} AND {at} THEN {x} END) OVER (PARTITION BY symbol)"


def ema_table(name: str, x: str, p: int, source: str = "n", first: int = 0, seed_from: int | None = None) -> list[str]:
    at = first + p - 1
    frm = first if seed_from is None else seed_from
    return [
        f"{name}_in AS MATERIALIZED (SELECT symbol, rn, {x} AS x, {averaged(x, frm, at)} AS seed FROM {source})",
        recursion(
            name, f"{name}_in", at, {name: "seed"}, {name: f"p.{name} + 2.0 / {p + 1} * (b.x - p.{name})"}
        ),
    ]


def ema_columns(periods: list[int]) -> tuple[dict[str, str], str, list[str]]:
    tables = [t for p in periods for t in ema_table(f"ema_{p}", "close", p)]
    return same(*[f"ema_{p}" for p in periods]), joined(*[f"ema_{p}" for p in periods]), tables


ORACLE["ema"] = select(*ema_columns([5, 9, 13, 20, 21, 50, 100, 200]))
ORACLE["elder_ray"] = select(
    {"bull_power": "high - ema_13", "bear_power": "low - ema_13"}, *ema_columns([13])[1:]
)
ORACLE["ewma"] = select(
    {"ewma_30": "e"},
    joined("e"),
    [recursion("e", "n", 0, {"e": "close"}, {"e": "p.e + 2.0 / 31 * (b.close - p.e)"})],
)
ORACLE["volatility_cluster"] = select(
    {"vol_cluster": "CASE WHEN high - low > num / den THEN 1 ELSE 0 END"},
    joined("e"),
    [
        recursion(
            "e",
            "n",
            0,
            {"num": "high - low", "den": "1"},
            {"num": "p.num * 29 / 31 + (b.high - b.low)", "den": "p.den * 29 / 31 + 1"},
        )
    ],
)


def wilder_table(name: str, x: dict[str, str], p: int, source: str = "n", first: int = 1) -> list[str]:
    at = first + p - 1
    seeds = ", ".join(f"{e} AS x_{c}, {averaged(e, first, at)} AS seed_{c}" for c, e in x.items())
    return [
        f"{name}_in AS MATERIALIZED (SELECT symbol, rn, {seeds} FROM {source})",
        recursion(
            name,
            f"{name}_in",
            at,
            {c: f"seed_{c}" for c in x},
            {c: f"(p.{c} * {p - 1} + b.x_{c}) / {p}" for c in x},
        ),
    ]


def changes(p: int) -> list[str]:
    return wilder_table(
        f"w{p}", {f"g{p}": "greatest(close - prev, 0)", f"l{p}": "greatest(prev - close, 0)"}, p
    )


def rsi(p: int) -> str:
    return f"CASE WHEN g{p} + l{p} = 0 THEN 0 ELSE 100 * g{p} / (g{p} + l{p}) END"


ORACLE["rsi"] = select({"rsi_14": rsi(14), "rsi_9": rsi(9)}, joined("w14", "w9"), changes(14) + changes(9))
ORACLE["cmo"] = select(
    {"cmo_14": "CASE WHEN g14 + l14 = 0 THEN 0 ELSE 100 * (g14 - l14) / (g14 + l14) END"},
    joined("w14"),
    changes(14),
)
ORACLE["volume_rsi"] = select(
    {"vw_rsi": f"({rsi(14)}) * tick_volume / {mean(14, 'tick_volume')}"}, joined("w14"), changes(14)
)
ORACLE["atr"] = select(
    same("atr_14", "atr_50"),
    joined("a14", "a50"),
    wilder_table("a14", {"atr_14": "tr"}, 14) + wilder_table("a50", {"atr_50": "tr"}, 50),
)
_KELTNER = ema_table("ema_20", "close", 20) + wilder_table("a14", {"atr_14": "tr"}, 14)
ORACLE["keltner"] = select(
    {
        "keltner_upper": "ema_20 + 2 * atr_14",
        "keltner_lower": "ema_20 - 2 * atr_14",
        "keltner_break": "CASE WHEN close > ema_20 + 2 * atr_14 THEN 1 "
        "WHEN close < ema_20 - 2 * atr_14 THEN -1 ELSE 0 END",
    },
    joined("ema_20", "a14"),
    _KELTNER,
)


def macd_tables(x: str, source: str = "n") -> list[str]:
    return [
        *ema_table("fast", x, 12, source, first=14),
        *ema_table("slow", x, 26, source),
        "line AS MATERIALIZED (SELECT symbol, rn, fast - slow AS m FROM fast JOIN slow USING (symbol, rn))",
        *ema_table("sig", "m", 9, "line", first=25),
    ]


_MACD = {"macd": "CASE WHEN n.rn >= 33 THEN m END", "macd_signal": "sig", "macd_hist": "m - sig"}
ORACLE["macd"] = select(_MACD, joined("line", "sig"), macd_tables("close"))
ORACLE["vwmacd"] = select(
    {"vwmacd": "CASE WHEN n.rn >= 33 THEN m END", "vwmacd_signal": "sig"},
    joined("line", "sig"),
    [
        f"v AS MATERIALIZED (SELECT symbol, rn, sum(close * tick_volume) {CUM} / sum(tick_volume) {CUM} AS vw FROM n)",
        *macd_tables("vw", "v"),
    ],
)
ORACLE["macd_divergence"] = select(
    {
        "macd_divergence": "(h - avg(h) OVER s) / stddev_pop(h) OVER s "
        "- (close - avg(c) OVER s) / stddev_pop(c) OVER s"
    },
    "(SELECT *, m - sig AS h, CASE WHEN sig IS NOT NULL THEN close END AS c FROM "
    + joined("line", "sig")
    + ") WINDOW s AS (PARTITION BY symbol)",
    macd_tables("close"),
)
_MOVES = """d AS MATERIALIZED (SELECT symbol, rn,
        CASE WHEN high - prev_high > prev_low - low AND high > prev_high THEN high - prev_high ELSE 0 END AS pm,
        CASE WHEN prev_low - low > high - prev_high AND prev_low > low THEN prev_low - low ELSE 0 END AS mm,
        tr FROM n)"""


def adx_tables(p: int = 14) -> list[str]:
    first = {c: f"sum(CASE WHEN rn BETWEEN 1 AND {p - 1} THEN {c} END) OVER (PARTITION BY symbol)" for c in ("pm", "mm", "tr")}
    seeds = ", ".join(f"{e} AS s_{c}" for c, e in first.items())
    return [
        _MOVES,
        f"di AS MATERIALIZED (SELECT *, {seeds} FROM d)",
        recursion(
            "dm",
            "di",
            p - 1,
            {"sp": "s_pm", "sm": "s_mm", "st": "s_tr"},
            {s: f"p.{s} - p.{s} / {p} + b.{c}" for s, c in (("sp", "pm"), ("sm", "mm"), ("st", "tr"))},
        ),
        "dx AS MATERIALIZED (SELECT symbol, rn, coalesce(100 * abs(100 * sp / st - 100 * sm / st) "
        "/ nullif(100 * sp / st + 100 * sm / st, 0), 0) AS dx FROM dm)",
        *wilder_table("a", {"adx": "dx"}, p, "dx", first=p),
    ]


ORACLE["adx"] = select({"adx_14": "adx"}, joined("a"), adx_tables())
ORACLE["trend_strength"] = select({"trend_strength": "adx"}, joined("a"), adx_tables())
ORACLE["chaikin_oscillator"] = select(
    {"adl": "CASE WHEN n.rn >= 9 THEN f - s END"},
    joined("e"),
    [
        _AD,
        f"ad AS MATERIALIZED (SELECT symbol, rn, sum(mf) {CUM} AS ad FROM a)",
        recursion(
            "e",
            "ad",
            0,
            {"f": "ad", "s": "ad"},
            {"f": "p.f + 2.0 / 4 * (b.ad - p.f)", "s": "p.s + 2.0 / 11 * (b.ad - p.s)"},
        ),
    ],
)
ORACLE["moving_average"] = select(
    {"sma_7": mean(7, "high"), "sma_30": mean(30, "high"), "ema_7": "ema_7"},
    joined("ema_7"),
    ema_table("ema_7", "high", 7),
)
ORACLE["dynamic_indicators"] = select(
    {"sma_4": mean(4, "close"), "sma_12": mean(12, "close"), "rsi_10": rsi(10)}, joined("w10"), changes(10)
)

# --- joins ----------------------------------------------------------------------------------

_QUOTES = (
    "quotes AS (SELECT event_type AS symbol, last(value ORDER BY ts, event_id) - 0.025 AS bid, "
    "last(value ORDER BY ts, event_id) + 0.025 AS ask FROM events GROUP BY 1)"
)
ORACLE["quotes_on_bars"] = select(
    {"close": "close", "bid": "bid", "ask": "ask", "last_price": "(bid + ask) / 2"},
    "n LEFT JOIN quotes USING (symbol)",
    [_QUOTES],
)
_MARKET = [
    bar_table("mb", symbol="'ALL'"),
    "mr AS (SELECT time, ln(close / lag(close) OVER (ORDER BY time)) AS m FROM mb)",
    "mn AS (SELECT * FROM mr WHERE m IS NOT NULL)",
]
ORACLE["market_returns"] = (
    "WITH "
    + ", ".join(_MARKET)
    + f" SELECT epoch(time)::BIGINT AS time, {rounded('m', 'market_log_ret')} FROM mn"
)
ORACLE["market_risk"] = select(
    {"beta": "b", "market_correlation": "k"},
    "n LEFT JOIN y USING (symbol, time)",
    [
        *_MARKET,
        "j AS (SELECT symbol, time, r, m FROM n JOIN mn USING (time) WHERE r IS NOT NULL)",
        f"y AS (SELECT symbol, time, {full(30, 'covar_samp(r, m)', 'r')} / {full(30, 'var_samp(m)', 'r')} AS b, "
        f"{full(30, 'corr(r, m)', 'r')} AS k FROM j)",
    ],
)
ORACLE["wavelet"] = select(
    {"wavelet_coeff": "coalesce(w, 0)"},
    "n LEFT JOIN p USING (symbol, rn)",
    [
        f"z AS (SELECT symbol, time, close, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS back FROM n)",
        f"k AS (SELECT symbol, close, row_number() OVER {W} - 1 AS i FROM z WHERE back <= 30)",
        "p AS (SELECT symbol, i // 2 AS rn, sum(close) / sqrt(2) AS w FROM k GROUP BY 1, 2)",
    ],
)
_COMPLETE = {
    "sma_21": mean(21, "close"),
    "roc_10": f"(close / lag(close, 10) OVER {W} - 1) * 100",
    "close_lag3": f"lag(close, 3) OVER {W}",
}
ORACLE["complete_rows"] = (
    "SELECT * FROM (" + select(_COMPLETE) + ") WHERE sma_21 IS NOT NULL AND roc_10 IS NOT NULL AND close_lag3 IS NOT NULL"
)

# --- bars -----------------------------------------------------------------------------------

_PRICES = ["open", "high", "low", "close", "tick_volume"]
ORACLE["hourly_bars"] = select(same(*_PRICES))
ORACLE["csv_round_trip"] = select(same(*_PRICES))

# --- wide tables ----------------------------------------------------------------------------


def wide(columns: list[str], complete: bool = False) -> str:
    """The columns of many queries above side by side, each from the first that shows it."""
    home: dict[str, str] = {}
    for member, sql in ORACLE.items():
        for c in re.findall(r"\+ 0\.0 AS (\w+)", sql):
            home.setdefault(c, member)
    taken = {c: f"m_{home[c]}.{c}" for c in columns if c in home}
    taken |= {c: e for c, e in _OTHER_NAMES.items() if c in columns}
    members = list(dict.fromkeys([home[c] for c in columns if c in home] + ["macd"]))
    parts = ", ".join(f"m_{m} AS MATERIALIZED ({ORACLE[m]})" for m in members)
    source = f"m_{members[0]} " + " ".join(f"JOIN m_{m} USING (symbol, time)" for m in members[1:])
    sql = f"WITH {parts} SELECT symbol, time, {', '.join(f'{taken[c]} AS {c}' for c in columns)} FROM {source}"
    return sql + " WHERE " + " AND ".join(f"{taken[c]} IS NOT NULL" for c in columns) if complete else sql


_OTHER_NAMES = {"signal_macd": "m_macd.macd_signal", "spread": "CAST(0.025 AS DOUBLE)"}
# The columns of the wide tables.
_STANDARD = """open high low close tick_volume bid ask last_price beta market_correlation wavelet_coeff
    volatility change_percent avg_price sma_5 sma_9 sma_21 sma_50 sma_100 sma_200 ema_5 ema_9 ema_21 ema_50 ema_100
    ema_200 rsi_14 rsi_9 macd signal_macd bb_upper21 bb_lower21 bb_upper9 bb_lower9 bb_upper50 bb_lower50 atr_14 roc_10
    obv mfi_14 rolling_max_20 rolling_min_20 std_dev_20 adx_14 vwap obv_10 obv_20 obv_50 obv_100 ichi_conversion
    ichi_base ichi_leading_span_a ichi_leading_span_b vwmacd vwmacd_signal volume_skew volume_kurtosis hurst_30 es_95
    omega_ratio vol_cluster haar_approx haar_detail log_ret max_drawdown volatility_30 sharpe_ratio sortino_ratio
    ewma_30 returns_skewness returns_kurtosis ulcer_index""".split()
_FURTHER = """trend_strength volatility_regime zscore_vol atr_50 rolling_volatility_20 bb_width bollinger_percent_b ema_20
    keltner_upper keltner_lower keltner_break roc_5 roc_20 williams_r_14 momentum_10 macd_signal macd_hist stoch_k stoch_d
    cci_14 cmo_14 tr plus_dm minus_dm plus_dm_sum minus_dm_sum tr_sum plus_vi minus_vi ema_13 bull_power bear_power cmf_20
    mfi_10 vwap_20 vroc_14 volume_profile adl vw_rsi sma_diff_50_200 sma_cross_signal_50_200 sma_diff_9_21
    sma_cross_signal_9_21 hma_9 hma_14 hma_21 hma_50 hma_100 cum_max drawdown var_95 df_stat_30""".split()
_LAGS = [f"{c}_lag{i}" for i in (1, 2, 3) for c in ("low", "high", "open", "close")]
_JOINED = "open high low close tick_volume bid ask last_price beta market_correlation wavelet_coeff".split()
_MODEL = """plus_dm plus_dm_sum minus_dm minus_dm_sum adl ask atr_14 atr_50 avg_price bear_power beta bid
    bollinger_percent_b bull_power cci_14 change_percent cmf_20 close cum_max drawdown ema_13 ema_20 ewma_30 high hma_14
    hma_50 last_price low log_ret macd macd_hist macd_signal momentum_10 mfi_10 open obv roc_20 roc_5 rsi_14 sharpe_ratio
    sma_100 sma_200 sma_21 sma_50 sma_9 sma_cross_signal_50_200 sma_cross_signal_9_21 sma_diff_50_200 sma_diff_9_21 spread
    stoch_d stoch_k tick_volume tr_sum ulcer_index vwap_20 volume_profile vw_rsi vroc_14 williams_r_14 zscore_vol""".split()
ORACLE["all_feature_sets"] = wide([c for c in _STANDARD if c not in _JOINED] + _FURTHER + _LAGS)
ORACLE["feature_pipeline"] = wide(_STANDARD, complete=True)
ORACLE["model_features_in_sql"] = wide(_MODEL + _LAGS)
ORACLE["five_minute_bars"] = (
    "WITH " + bar_table("bars", 300) + " SELECT symbol, epoch(time)::BIGINT AS time, "
    + ", ".join(rounded(c, c) for c in _PRICES) + " FROM bars"
)
ORACLE["daily_order_bars"] = f"""WITH bars AS (
        SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate) AS time,
            first(o_totalprice ORDER BY o_orderdate, o_orderkey) AS open, max(o_totalprice) AS high,
            min(o_totalprice) AS low, last(o_totalprice ORDER BY o_orderdate, o_orderkey) AS close,
            count(*) AS tick_volume FROM orders GROUP BY 1, 2)
    SELECT symbol, epoch(time)::BIGINT AS time, {", ".join(rounded(c, c) for c in _PRICES)},
        {rounded(mean(9, "close"), "sma_9")}, {rounded(f"ln(close / lag(close) OVER {W})", "log_ret")} FROM bars"""
ORACLE["newest_bars"] = select(
    same(*_PRICES),
    "(SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS back FROM n)",
    where="WHERE back <= 60",
)
ORACLE["epoch_and_text_times"] = """SELECT event_id,
        strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS from_seconds,
        epoch(date_trunc('second', ts))::BIGINT AS from_text FROM events"""
ORACLE["bar_validation"] = """WITH raw AS (
        SELECT event_type AS symbol, date_trunc('minute', ts) AS time, value * 1.01 AS open,
            value * CASE WHEN event_id % 7 = 0 THEN 1.005 ELSE 1.02 END AS high,
            value * CASE WHEN event_id % 11 = 0 THEN 1.001 ELSE 0.98 END AS low, value AS close FROM events),
    checked AS (SELECT *, CASE WHEN high < greatest(open, close, low) THEN 'high'
            WHEN low > least(open, close) THEN 'low'
            WHEN count(*) OVER (PARTITION BY symbol, time) > 1 THEN 'repeated' ELSE 'good' END AS reason FROM raw)
    SELECT symbol, reason, count(*) AS bars FROM checked GROUP BY 1, 2"""
ORACLE["order_intents"] = f"""WITH {_QUOTES},
    info AS (SELECT event_type AS symbol, avg(value) / 100 AS volume_min FROM events GROUP BY 1),
    o AS (SELECT event_id AS order_id, event_type AS symbol, value,
            CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side FROM events),
    s AS (SELECT *, round(value / ask, 2) AS volume FROM o JOIN quotes USING (symbol) JOIN info USING (symbol))
    SELECT order_id, symbol, side, {rounded("CASE WHEN side = 'buy' THEN ask ELSE bid END", "price")},
        {rounded("volume", "volume")}, CASE WHEN side = 'buy' THEN 1000 ELSE 1001 END::BIGINT AS magic,
        10::BIGINT AS deviation, (volume < volume_min)::BIGINT AS rejected FROM s"""
# Sao Paulo has kept UTC-3 without summer time since 2019; all events are of 2024.
_LOCAL = "(time - INTERVAL 3 HOUR)"
ORACLE["session_hours"] = select(
    {"close": "close"}, where=f"WHERE strftime({_LOCAL}, '%H:%M:%S') BETWEEN '00:00:00' AND '19:55:00'"
)

# --- labels, trades, reports ----------------------------------------------------------------

_LABELS = [
    f"l0 AS (SELECT *, close / prev - 1 AS cr, lead(close, 9) OVER {W} / close - 1 AS fr FROM n)",
    "lab AS MATERIALIZED (SELECT symbol, time, close, cr, fr, CASE WHEN cr < 0 AND fr > 0.0035 THEN 1 "
    "WHEN cr > 0 AND fr < -0.0035 THEN -1 ELSE 0 END AS target FROM l0 WHERE fr IS NOT NULL)",
]
ORACLE["reversal_label"] = select(
    {"current_return": "cr", "future_return": "fr", "target": "target"}, "lab", _LABELS
)
ORACLE["label_counts"] = (
    "WITH "
    + ", ".join([bar_table("bars"), NUMBERED, *_LABELS])
    + " SELECT symbol, target::BIGINT AS target, count(*) AS bars FROM lab GROUP BY 1, 2"
)
_LABEL_SIGNALS = [*_LABELS, "sig AS (SELECT symbol, time, close, target AS s, false AS reset FROM lab)"]
_CROSS_SIGNALS = [
    _DIFFS,
    _CROSS,
    f"sig AS (SELECT symbol, time, close, coalesce((sa - lag(sa) OVER {W}) // 2, 0) AS s, false AS reset FROM c)",
]
_LATE = f"strftime({_LOCAL}, '%H:%M:%S') >= '17:55:00'"
_SESSION_SIGNALS = [
    *_LABELS,
    f"late AS (SELECT *, {_LATE} AS late, CAST({_LOCAL} AS DATE) AS day FROM lab)",
    "sig AS (SELECT symbol, time, close, target AS s, late AND row_number() OVER "
    "(PARTITION BY symbol, day, late ORDER BY time) = 1 AS reset FROM late)",
]
_END_SIGNALS = [
    *_LABELS,
    "sig AS (SELECT symbol, time, close, target AS s, time = max(time) OVER (PARTITION BY symbol) AS reset FROM lab)",
]


def book(signals: list[str], stake: int = 20000, exits: int = 2) -> list[str]:
    """The position machine, one bar at a time, and the money that follows from it."""
    mark = f"(close - side * {0.025 * min(exits, 1)})"
    held = "CASE WHEN b.reset THEN 0 ELSE least(1, greatest(-1, p.st + b.s)) END"
    return [
        *signals,
        f"q AS MATERIALIZED (SELECT *, row_number() OVER {W} - 1 AS rn FROM sig)",
        recursion(
            "pos",
            "q",
            0,
            {"was": "0", "st": "CASE WHEN reset THEN 0 ELSE s END", "entry": "close + s * 0.025", "id": "CASE WHEN reset THEN 0 ELSE abs(s) END"},
            {
                "was": "p.st",
                "st": held,
                "entry": f"CASE WHEN p.st = 0 THEN b.close + ({held}) * 0.025 ELSE p.entry END",
                "id": f"p.id + CASE WHEN p.st = 0 AND ({held}) <> 0 THEN 1 ELSE 0 END",
            },
        ),
        "k AS (SELECT *, was = 0 AND st <> 0 AS opens, was <> 0 AND st = 0 AS closes, "
        "CASE WHEN was <> 0 AND st = 0 THEN was ELSE st END AS side FROM q JOIN pos USING (symbol, rn))",
        f"m AS (SELECT *, CASE WHEN closes THEN {stake} / entry * side * (close - {exits} * side * 0.025 - entry) ELSE 0 END AS pnl FROM k)",
        f"""book AS (SELECT symbol, time, close, pnl, opens, closes, side, CASE WHEN side = 0 THEN 'Sem Operação'
            WHEN opens THEN CASE WHEN side = 1 THEN 'Compra' ELSE 'Venda' END
            WHEN closes AND reset THEN 'Fechado Horário'
            WHEN closes THEN CASE WHEN side = 1 THEN 'Reversão Long' ELSE 'Reversão Short' END
            WHEN side = 1 THEN 'Comprado' ELSE 'Vendido' END AS state,
            CASE WHEN opens THEN entry END AS entry_price,
            CASE WHEN closes THEN {mark} END AS exit_price,
            pnl / {stake} * 100 AS result_pct,
            CASE WHEN side = 0 THEN NULL WHEN opens THEN 0 WHEN closes THEN pnl
                ELSE {stake} / entry * side * ({mark} - entry) END AS running_pnl,
            CASE WHEN side <> 0 THEN id END AS trade_id FROM m)""",
    ]


def book_query(signals: list[str], query: str, **terms: int) -> str:
    tables = [bar_table("bars"), NUMBERED, *book(signals, **terms)]
    return "WITH RECURSIVE " + ",\n    ".join(tables) + "\n    " + query


_BOOK_COLUMNS = "SELECT symbol, epoch(time)::BIGINT AS time, state, " + ", ".join(
    rounded(c, c) for c in ("entry_price", "exit_price", "pnl", "result_pct", "running_pnl", "trade_id")
) + " FROM book"
ORACLE["ledger_of_labels"] = book_query(_LABEL_SIGNALS, _BOOK_COLUMNS)
ORACLE["ledger_of_crossings"] = book_query(_CROSS_SIGNALS, _BOOK_COLUMNS)
ORACLE["ledger_with_session_close"] = book_query(_SESSION_SIGNALS, _BOOK_COLUMNS)
ORACLE["ledger_closed_at_end"] = book_query(_END_SIGNALS, _BOOK_COLUMNS)
ORACLE["trades"] = book_query(
    _LABEL_SIGNALS,
    f"""SELECT symbol, trade_id::BIGINT AS trade_id, epoch(min(time))::BIGINT AS open_time,
        {rounded("epoch(max(CASE WHEN closes THEN time END))", "close_time")}, max(side)::BIGINT AS side,
        {rounded("max(entry_price)", "entry_price")}, {rounded("max(exit_price)", "exit_price")},
        {rounded("count(*) - 1", "bars_held")}, {rounded("sum(pnl)", "pnl")}
        FROM book WHERE trade_id IS NOT NULL GROUP BY symbol, trade_id""",
)
_CLOSED = "state IN ('Fechado Horário', 'Reversão Long', 'Reversão Short')"
_COUNTED = (
    "sum(pnl) AS total, count(*)::BIGINT AS num_transactions, count_if(pnl > 0)::BIGINT AS num_profit_transactions, "
    f"count_if(pnl < 0)::BIGINT AS num_loss_transactions, count_if({_CLOSED})::BIGINT AS num_trades"
)


def results(period: str, name: str) -> str:
    return f"(SELECT symbol, CAST({period} AS DATE) AS {name}, {_COUNTED} FROM book GROUP BY 1, 2)"


_DAILY = results("time", "date")
_MONTHLY = results("date_trunc('month', time)", "month")
_COUNT_NAMES = "num_transactions, num_profit_transactions, num_loss_transactions, num_trades"


def result_columns(name: str) -> str:
    return f"SELECT symbol, CAST({name} AS VARCHAR) AS {name}, {rounded('total', 'total_profit_loss')}, {_COUNT_NAMES}"


ORACLE["daily_results"] = book_query(_CROSS_SIGNALS, f"{result_columns('date')} FROM {_DAILY}")
ORACLE["monthly_results"] = book_query(_LABEL_SIGNALS, f"{result_columns('month')} FROM {_MONTHLY}")
ORACLE["monthly_mean"] = book_query(
    _LABEL_SIGNALS, f"SELECT symbol, {rounded('avg(total)', 'monthly_mean')} FROM {_MONTHLY} GROUP BY 1"
)
_RECENT = f"(SELECT *, date >= max(date) OVER (PARTITION BY symbol) - 30 AS recent FROM {_DAILY})"
ORACLE["last_days"] = book_query(_LABEL_SIGNALS, f"{result_columns('date')} FROM {_RECENT} WHERE recent")
ORACLE["recent_statistics"] = book_query(
    _LABEL_SIGNALS,
    f"""SELECT symbol, {rounded("sum(CASE WHEN recent THEN total END)", "total_30")},
        {rounded("avg(CASE WHEN recent THEN total END)", "mean_30")},
        {rounded("stddev_samp(total)", "std_30")} FROM {_RECENT} GROUP BY 1""",
)
_CLOSED_STATS = f"""(SELECT symbol, count_if(pnl > 0)::BIGINT AS wins, count_if(pnl < 0)::BIGINT AS losses,
        coalesce(sum(CASE WHEN pnl > 0 THEN pnl END), 0) AS sum_profit,
        coalesce(sum(CASE WHEN pnl < 0 THEN pnl END), 0) AS sum_loss,
        max(pnl) AS max_gain, min(pnl) AS max_loss FROM book WHERE {_CLOSED} GROUP BY 1)"""
_CLOSED_NAMES = ", ".join(rounded(c, c) for c in ("sum_profit", "sum_loss", "max_gain", "max_loss"))
ORACLE["closed_trades"] = book_query(
    _LABEL_SIGNALS, f"SELECT symbol, wins, losses, {_CLOSED_NAMES} FROM {_CLOSED_STATS}"
)
_SUMMARY = (
    "(SELECT symbol, sum(pnl) AS total_pnl, sum(pnl) / 1000 * 100 AS roi_pct, "
    "1000 + sum(pnl) AS final_capital FROM book GROUP BY 1)"
)
_SUMMARY_NAMES = ", ".join(rounded(c, c) for c in ("total_pnl", "roi_pct", "final_capital"))
ORACLE["summary"] = book_query(_LABEL_SIGNALS, f"SELECT symbol, {_SUMMARY_NAMES} FROM {_SUMMARY}")
ORACLE["results_table"] = book_query(
    _LABEL_SIGNALS,
    f"SELECT symbol, wins, losses, {_SUMMARY_NAMES}, {_CLOSED_NAMES} "
    f"FROM {_SUMMARY} LEFT JOIN {_CLOSED_STATS} USING (symbol)",
)

# --- learning -------------------------------------------------------------------------------

_BASE = [bar_table("bars"), NUMBERED]
_FEATURED = f"ft AS (SELECT symbol, time, {mean(9, 'close')} AS s, (close / lag(close, 5) OVER {W} - 1) * 100 AS o, lead(close, 9) OVER {W} AS later FROM n)"
ORACLE["imputed_scaled_features"] = select(
    {
        "sma_9": "(s - avg(s) OVER ()) / stddev_pop(s) OVER ()",
        "roc_5": "(o - avg(o) OVER ()) / stddev_pop(o) OVER ()",
    },
    "filled",
    [
        _FEATURED,
        "kept AS (SELECT * FROM ft WHERE later IS NOT NULL)",
        "filled AS (SELECT symbol, time, coalesce(s, avg(s) OVER ()) AS s, coalesce(o, avg(o) OVER ()) AS o FROM kept)",
    ],
)
ORACLE["stratified_split"] = (
    "WITH "
    + ", ".join([*_BASE, *_LABELS])
    + " SELECT target::BIGINT AS target, round(count(*) * 0.3)::BIGINT AS test_rows, count(*) AS all_rows FROM lab GROUP BY 1"
)
ORACLE["whole_model"] = (
    "WITH "
    + ", ".join([bar_table("bars"), NUMBERED, *_LABELS])
    + f""", k AS (SELECT target, round(count(*) * 0.7)::BIGINT AS tested FROM lab GROUP BY 1),
        m AS (SELECT symbol, count(*) AS scored_rows FROM lab GROUP BY 1)
    SELECT symbol, m.scored_rows, 0::BIGINT AS changed_rows, (SELECT sum(tested)::BIGINT FROM k) AS test_rows,
        0.0::DOUBLE AS accuracy_gap, 1.0::DOUBLE AS importance_total, epoch(max(time))::BIGINT AS newest,
        {rounded("arg_max(open, time)", "last_open")}, true AS known
    FROM n JOIN m USING (symbol) GROUP BY 1, 2"""
)
ORACLE["ordered_split"] = (
    "WITH "
    + ", ".join([*_BASE, *_LABELS])
    + f""", o AS (SELECT symbol, time, row_number() OVER {W} - 1 >= count(*) OVER (PARTITION BY symbol)
            - round(count(*) OVER (PARTITION BY symbol) * 0.3) AS t FROM lab)
    SELECT symbol, count_if(t)::BIGINT AS test_rows, epoch(min(CASE WHEN t THEN time END))::BIGINT AS first_test
    FROM o GROUP BY 1"""
)

# --- streams --------------------------------------------------------------------------------

ORACLE["stream_bars"] = (
    "WITH "
    + bar_table("bars", 300)
    + " SELECT symbol, epoch(time)::BIGINT AS time, "
    + ", ".join(rounded(c, c) for c in _PRICES)
    + " FROM bars WHERE time + INTERVAL 15 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) FROM events)"
)
ORACLE["stream_positions"] = book_query(
    _SESSION_SIGNALS,
    "SELECT symbol, epoch(time)::BIGINT AS time, state, "
    + ", ".join(rounded(c, c) for c in ("entry_price", "exit_price", "pnl"))
    + ", "
    + rounded("CASE WHEN state IN ('Comprado', 'Vendido') THEN running_pnl ELSE 0 END", "unrealized_pnl")
    + f", {rounded('trade_id', 'trade_id')} FROM book",
    stake=2000,
    exits=0,
)

ORACLE["stream_features"] = "SELECT symbol, time, obv, ema_21, rsi_14, macd, adx_14 FROM " + " JOIN ".join(
    f"({ORACLE[name]}) {name}_table" + (" USING (symbol, time)" if i else "") for i, name in enumerate(["obv", "ema", "rsi", "macd", "adx"])
)

# Hourly bars that the stream has closed, inside the session, traded by the crossing of two means.
_ALERT_TABLES = [
    bar_table("every_bar"),
    f"bars AS MATERIALIZED (SELECT * FROM every_bar WHERE strftime({_LOCAL}, '%H:%M:%S') BETWEEN '00:00:00' AND '19:55:00' "
    "AND time + INTERVAL 70 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) FROM events))",
    NUMBERED,
    _DIFFS,
    _CROSS,
    f"lab AS (SELECT symbol, time, close, coalesce((sa - lag(sa) OVER {W}) // 2, 0) AS target FROM c)",
]
ORACLE["stream_alerts"] = (
    "WITH RECURSIVE "
    + ",\n    ".join([*_ALERT_TABLES, *book(_SESSION_SIGNALS[len(_LABELS) :], stake=2000, exits=0)])
    + f""",
    paid AS (SELECT *, sum(pnl) OVER {W} AS realized FROM book)
    SELECT symbol, epoch(time)::BIGINT AS time, state,
        concat_ws(' ', symbol, state, printf('%.4f', coalesce(entry_price, exit_price)),
            CASE WHEN exit_price IS NOT NULL THEN printf('%.2f (%.2f)', pnl, realized) END) AS message
    FROM paid WHERE entry_price IS NOT NULL OR exit_price IS NOT NULL"""
)
