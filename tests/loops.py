"""Row-by-row NumPy forms of the recursive features, written from their definitions."""

from __future__ import annotations

import datetime as dt
import math
from fractions import Fraction

import numpy as np
import pandas as pd

NAN = float("nan")


def walk(symbol: str, rows: int, seed: int, gaps: bool = True, seconds: int = 300) -> pd.DataFrame:
    """Random bars with missing intervals, equal closes and zero ranges."""
    rng = np.random.default_rng(seed)
    close = 50 + np.cumsum(np.round(rng.normal(0, 0.5, rows), 2) * (rng.random(rows) > 0.1))
    close = np.maximum(close, 1.0)
    open_ = np.concatenate([[close[0]], close[:-1]])
    width = np.round(rng.random(rows), 2) * (rng.random(rows) > 0.1)
    steps = np.where(rng.random(rows) < 0.05, rng.integers(2, 3000, rows), 1) if gaps else np.ones(rows, int)
    start = dt.datetime(2024, 1, 1)
    times = [start + dt.timedelta(seconds=int(s)) for s in np.cumsum(steps) * seconds]
    return pd.DataFrame(
        {
            "symbol": symbol,
            "time": times,
            "open": open_,
            "high": np.maximum(open_, close) + width,
            "low": np.minimum(open_, close) - width,
            "close": close,
            "tick_volume": rng.integers(1, 500, rows),
        }
    )


def ema(x, n, first=0, seed_from=None):
    y = np.full(len(x), NAN)
    at = first + n - 1
    if len(x) > at:
        y[at] = np.mean(x[(first if seed_from is None else seed_from) : at + 1])
        for t in range(at + 1, len(x)):
            y[t] = y[t - 1] + 2 / (n + 1) * (x[t] - y[t - 1])
    return y


def wilder(x, n, first=1):
    y = np.full(len(x), NAN)
    at = first + n - 1
    if len(x) > at:
        y[at] = np.mean(x[first : at + 1])
        for t in range(at + 1, len(x)):
            y[t] = (y[t - 1] * (n - 1) + x[t]) / n
    return y


def rolling(x, n, f):
    y = np.full(len(x), NAN)
    for t in range(n - 1, len(x)):
        w = x[t - n + 1 : t + 1]
        if not np.isnan(w).any():
            y[t] = f(w)
    return y


def wma(x, n):
    return rolling(x, n, lambda w: (w * np.arange(1, n + 1)).sum() / (n * (n + 1) / 2))


def hull(x, n):
    return wma(2 * wma(x, n // 2) - wma(x, n), int(np.sqrt(n)))


def macd(x):
    fast = np.full(len(x), NAN)
    fast[25] = np.mean(x[14:26])
    for t in range(26, len(x)):
        fast[t] = fast[t - 1] + 2 / 13 * (x[t] - fast[t - 1])
    line = fast - ema(x, 26)
    signal = ema(line, 9, first=25)
    line = np.where(np.arange(len(x)) >= 33, line, NAN)
    return line, signal


def rsi(c, n):
    d = np.diff(c, prepend=NAN)
    up, down = wilder(np.where(d > 0, d, 0.0), n), wilder(np.where(d < 0, -d, 0.0), n)
    return np.where(up + down == 0, 0.0, 100 * up / np.where(up + down == 0, 1, up + down)) + 0 * up


def true_range(b):
    prev = np.concatenate([[NAN], b.close[:-1]])
    return np.fmax(b.high - b.low, np.fmax(abs(b.high - prev), abs(b.low - prev)))


def adx(b, n=14):
    up, down = np.diff(b.high, prepend=NAN), -np.diff(b.low, prepend=NAN)
    plus = np.where((up > down) & (up > 0), up, 0.0)
    minus = np.where((down > up) & (down > 0), down, 0.0)
    size = len(up)

    def smooth(x):
        y = np.full(size, NAN)
        y[n - 1] = x[1:n].sum()
        for t in range(n, size):
            y[t] = y[t - 1] - y[t - 1] / n + x[t]
        return y

    p, m = smooth(plus), smooth(minus)
    dx = np.where(p + m == 0, 0.0, 100 * abs(p - m) / np.where(p + m == 0, 1, p + m))
    return wilder(dx, n, first=n)


def money_flow(b):
    span = np.where(b.high == b.low, 1, b.high - b.low)
    return np.where(b.high == b.low, 0.0, ((b.close - b.low) - (b.high - b.close)) / span) * b.tick_volume


def chaikin(b):
    line = np.cumsum(money_flow(b))
    fast, slow = line.copy(), line.copy()
    for t in range(1, len(line)):
        fast[t] = fast[t - 1] + 0.5 * (line[t] - fast[t - 1])
        slow[t] = slow[t - 1] + 2 / 11 * (line[t] - slow[t - 1])
    return np.where(np.arange(len(line)) >= 9, fast - slow, NAN)


def obv(b):
    d = np.diff(b.close, prepend=b.close[0] - 1)
    return np.cumsum(np.sign(d) * b.tick_volume)


def hurst(w):
    """Twice the least-squares slope of log(deviation of the changes over k rows) on log(k), k from 2 to 19."""
    points = []
    for k in range(2, 20):
        changes = [later - earlier for earlier, later in zip(w, w[k:])]
        mean = math.fsum(changes) / len(changes)
        deviation = math.sqrt(math.fsum((x - mean) ** 2 for x in changes) / len(changes))
        if deviation < 1e-12:
            return NAN
        points.append((math.log(k), math.log(deviation)))
    middle = math.fsum(x for x, _ in points) / len(points)
    rise = math.fsum((x - middle) * y for x, y in points)
    return 2 * rise / math.fsum((x - middle) ** 2 for x, _ in points)


def adf(w):
    """Augmented Dickey-Fuller with constant, lag by AIC on a common sample."""
    if np.ptp(w) == 0:
        return NAN

    def regress(lags, rows):
        d = np.diff(w)
        n = len(d)
        x = np.column_stack(
            [w[n - rows : n], *[d[n - rows - i : n - i] for i in range(1, lags + 1)], np.ones(rows)]
        )
        y = d[n - rows :]
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        rest = ((y - x @ beta) ** 2).sum()
        cov = rest / (rows - x.shape[1]) * np.linalg.inv(x.T @ x)
        return rest, beta[0] / np.sqrt(cov[0, 0])

    deepest = min(len(w) // 2 - 2, int(np.ceil(12 * (len(w) / 100) ** 0.25)))
    rows = len(w) - 1 - deepest
    aic = [rows * np.log(regress(p, rows)[0] / rows) + 2 * (p + 2) for p in range(deepest + 1)]
    best = int(np.argmin(aic))
    return regress(best, len(w) - 1 - best)[1]


def exact_adf(w):
    """The same in rational numbers."""
    w = [Fraction(float(v)) for v in w]
    d = [b - a for a, b in zip(w, w[1:])]

    def regress(lags, rows):
        first = len(d) - rows
        x = [[Fraction(1), *(d[i - k] for k in range(1, lags + 1)), w[i]] for i in range(first, len(d))]
        x = [[*row, y] for row, y in zip(x, d[first:])]
        m, width = [[sum(r[i] * r[j] for r in x) for j in range(lags + 3)] for i in range(lags + 3)], lags + 2
        for k in range(width):  # elimination leaves the residual sum in the corner
            for i in range(k + 1, width + 1):
                share = m[i][k] / m[k][k]
                m[i] = [a - share * b for a, b in zip(m[i], m[k])]
        rest, pivot, right = m[width][width], m[width - 1][width - 1], m[width - 1][width]
        return float(rest), float(right) / math.sqrt(float(pivot) * float(rest) / (rows - width))

    deepest = min(len(w) // 2 - 2, int(np.ceil(12 * (len(w) / 100) ** 0.25)))
    rows = len(d) - deepest
    aic = [rows * math.log(regress(p, rows)[0] / rows) + 2 * (p + 2) for p in range(deepest + 1)]
    best = int(np.argmin(aic))
    return regress(best, len(d) - best)[1]


def expected(b: pd.DataFrame) -> dict[str, np.ndarray]:
    """Every checked feature of one symbol's bars."""
    b = b.sort_values("time").reset_index(drop=True)
    cols = pd.Series({c: b[c].to_numpy(float) for c in ("open", "high", "low", "close", "tick_volume")})
    c = cols.close
    prev = np.concatenate([[NAN], c[:-1]])
    r = np.log(c / prev)
    tr = true_range(cols)
    line, signal = macd(c)
    vw = np.cumsum(c * cols.tick_volume) / np.cumsum(cols.tick_volume)
    vw_line, vw_signal = macd(vw)
    top = np.maximum.accumulate(c)
    return {
        "sma_200": rolling(c, 200, np.mean),
        "ema_5": ema(c, 5),
        "ema_200": ema(c, 200),
        "rsi_14": rsi(c, 14),
        "atr_50": wilder(tr, 50),
        "macd": line,
        "macd_signal": signal,
        "vwmacd": vw_line,
        "vwmacd_signal": vw_signal,
        "adx_14": adx(cols),
        "adl": chaikin(cols),
        "vwap": vw,
        "obv": obv(cols),
        "obv_100": rolling(obv(cols), 100, np.mean),
        "ewma_30": b["close"].ewm(span=30, adjust=False).mean().to_numpy(),
        "cum_max": top,
        "ulcer_index": np.sqrt(rolling((top - c) ** 2, 252, np.mean)),
        "hma_50": hull(c, 50),
        "hurst_30": rolling(c, 30, hurst),
        "es_95": rolling(r, 100, lambda w: w[w <= np.quantile(w, 0.05)].mean()),
        "var_95": rolling(r, 20, lambda w: np.percentile(w, 5)),
        "returns_skewness": pd.Series(r).rolling(30).skew().to_numpy(),
        "returns_kurtosis": pd.Series(r).rolling(30).kurt().to_numpy(),
        "vol_cluster": (
            (b["high"] - b["low"]) > (b["high"] - b["low"]).ewm(span=30).mean() * (1 + 1e-12)
        ).to_numpy(float),
    }


def machine(close, signal, reset, spread=0.025, stake=20000.0, exits=2):
    """States, profits and trade numbers by a plain loop."""
    names, pnl, ids = [], [], []
    side, entry, quantity, trades = 0, 0.0, 0.0, 0
    for c, s, cut in zip(close, signal, reset):
        profit, number = 0.0, None
        if side == 0:
            if s and not cut:
                side, entry, trades = s, c + s * spread, trades + 1
                quantity, number = stake / entry, trades
                names.append("Compra" if s == 1 else "Venda")
            else:
                names.append("Sem Operação")
        elif cut or s == -side:
            profit = quantity * side * (c - exits * side * spread - entry)
            names.append("Fechado Horário" if cut else "Reversão Long" if side == 1 else "Reversão Short")
            side, number = 0, trades
        else:
            names.append("Comprado" if side == 1 else "Vendido")
            number = trades
        pnl.append(profit)
        ids.append(number)
    return names, pnl, ids
