"""Rolling augmented Dickey-Fuller statistic with a constant and the lag chosen by AIC.

No built-in fits regressions of varying width over a window, so each block (bounded rows, with
the rows before it that its windows need) is one Arrow batch.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barweave.operators.blocks import lay_out, number_rows

BLOCK_ROWS = 512
INDEPENDENT = 1e-7  # the least share of a column that the columns before it must leave


def _fit(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least squares of stacked problems: residual sums and t value of column 1."""
    gram = np.swapaxes(x, 1, 2) @ x
    inverse = np.linalg.pinv(gram, hermitian=True)
    beta = inverse @ (np.swapaxes(x, 1, 2) @ y[..., None])
    rest = ((y[..., None] - x @ beta) ** 2).sum(axis=(1, 2))
    scale = rest / (x.shape[1] - x.shape[2])
    with np.errstate(divide="ignore", invalid="ignore"):
        t = beta[:, 1, 0] / np.sqrt(scale * inverse[:, 1, 1])
    return rest, t


def _design(w: np.ndarray, d: np.ndarray, lags: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Differences to explain, and [1, level before, `lags` earlier differences]."""
    n = d.shape[1]
    columns = [np.ones((len(w), rows)), w[:, n - rows : n]]
    columns += [d[:, n - rows - i : n - i] for i in range(1, lags + 1)]
    return d[:, n - rows :], np.stack(columns, axis=2)


def _orthogonal_fit(y: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least squares column by column (modified Gram-Schmidt) for stacked problems.

    Returns the residual sums after each column, the part of y along the last one, and which
    problems have independent columns. One pass gives the residuals of all nested models, and no
    sums of products are subtracted from each other.
    """
    rest, done, sums = y.copy(), [], []
    sound, along = np.ones(len(y), bool), np.zeros(len(y))
    for column in columns:
        c, size = column.copy(), np.sqrt((column * column).sum(axis=1))
        for q in done:
            c -= (q * c).sum(axis=1, keepdims=True) * q
        left = np.sqrt((c * c).sum(axis=1))
        sound &= left > INDEPENDENT * size
        q = c / np.where(left > 0, left, 1.0)[:, None]
        along = (q * rest).sum(axis=1)
        rest -= along[:, None] * q
        done.append(q)
        sums.append((rest * rest).sum(axis=1))
    return np.stack(sums), along, sound


def _criterion(rest: np.ndarray, rows: int, lags: np.ndarray | int) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return rows * (np.log(2 * np.pi) + np.log(rest / rows) + 1) + 2 * (lags + 2)


def adf_statistics(windows: np.ndarray) -> np.ndarray:
    """ADF statistic per row of `windows`; NaN for constant or missing input.

    The criteria of all lags come from one orthogonal pass over the design with the most lags. The
    statistic is that of the level as the last column of the chosen design. Windows with dependent
    columns take the pseudo-inverse instead.
    """
    result = np.full(len(windows), np.nan)
    usable = np.isfinite(windows).all(axis=1) & (np.ptp(windows, axis=1) > 0)
    raw = windows[usable]
    if not len(raw):
        return result
    # The statistic does not change under shift and scale; both keep the fits well conditioned.
    w = (raw - raw.mean(axis=1, keepdims=True)) / raw.std(axis=1, keepdims=True)
    d = np.diff(w, axis=1)
    deepest = _deepest(w.shape[1])
    rows = d.shape[1] - deepest
    y, x = _design(w, d, deepest, rows)
    sums, _, sound = _orthogonal_fit(y, list(np.moveaxis(x, 2, 0)))
    best = np.argmin(_criterion(sums[1:], rows, np.arange(deepest + 1)[:, None]), axis=0)
    t = np.empty(len(w))
    for lags in np.unique(best):
        chosen = np.flatnonzero(best == lags)
        y, x = _design(w[chosen], d[chosen], int(lags), d.shape[1] - int(lags))
        columns = list(np.moveaxis(x, 2, 0))
        sums, along, apart = _orthogonal_fit(y, [columns[0], *columns[2:], columns[1]])
        with np.errstate(divide="ignore", invalid="ignore"):
            t[chosen] = along / np.sqrt(sums[-1] / (y.shape[1] - len(columns)))
        sound[chosen] &= apart
    if not sound.all():
        t[~sound] = _by_pseudo_inverse(w[~sound], d[~sound])
    result[usable] = t
    return result


def _deepest(size: int) -> int:
    return min(size // 2 - 2, math.ceil(12 * (size / 100) ** 0.25))


def _by_pseudo_inverse(w: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The same with one fit per lag, for windows whose columns depend on each other."""
    deepest = _deepest(w.shape[1])
    rows = d.shape[1] - deepest
    rests = [_fit(*_design(w, d, lags, rows))[0] for lags in range(deepest + 1)]
    best = np.argmin(np.stack([_criterion(rest, rows, lags) for lags, rest in enumerate(rests)]), axis=0)
    t = np.empty(len(w))
    for lags in np.unique(best):
        chosen = best == lags
        _, t[chosen] = _fit(*_design(w[chosen], d[chosen], int(lags), d.shape[1] - int(lags)))
    return t


def rolling_adf(
    bars: DataFrame, bar_seconds: int, n: int = 30, column: str = "close", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(symbol, time, adf_stat_{n}); NULL until n rows exist."""
    name = f"adf_stat_{n}"
    numbered = bars if "rn" in bars.columns else number_rows(bars.select("symbol", "time", column), bar_seconds)
    laid = lay_out(
        numbered.select("symbol", "time", "rn", F.col(column).cast("double").alias("x")), block_rows, back=n - 1
    )

    def one_block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rn")
        x = rows["x"].to_numpy()
        out = np.full(len(x), np.nan)
        if len(x) >= n:
            out[n - 1 :] = adf_statistics(np.lib.stride_tricks.sliding_window_view(x, n))
        kept = (rows["rn"] // block_rows == rows["blk"]).to_numpy()
        return pd.DataFrame(
            {"symbol": rows["symbol"][kept], "time": rows["time"][kept], name: out[kept]}
        )

    result = laid.groupBy("symbol", "blk").applyInPandas(
        one_block, f"symbol string, time timestamp, {name} double"
    )
    return result.withColumn(name, F.nanvl(F.col(name), F.lit(None).cast("double")))
