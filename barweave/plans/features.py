"""Computing any choice of features for all symbols in one job."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barweave.functions.rolling import Frame
from barweave.operators.blocks import lay_out, number_rows, own_row
from barweave.operators.scan import MAX_EXPONENT, Tiling, run_scans
from barweave.plans import registry
from barweave.plans.registry import Feature, q
from barweave.session import stage

KEYS = ["symbol", "time"]
SMALL_BLOCK = 256
LARGE_BLOCK = 1400


def gather(names: list[str], own: dict[str, Feature], columns: list[str]) -> dict[str, Feature]:
    """The wanted features and everything they need, inputs before users."""
    found: dict[str, Feature] = {}

    def visit(name: str) -> None:
        if name in found or name in columns:
            return
        feature = own.get(name) or registry.resolve(name)
        if feature is None:
            raise ValueError(f"unknown feature or missing input column: {name}")
        for need in feature.needs:
            visit(need)
        found[name] = feature

    for name in names:
        visit(name)
    return found


def _levels(found: dict[str, Feature]) -> tuple[dict[str, int], dict[str, int], dict[int, int]]:
    """Scan level and rows looked back of every feature, and of the scan inputs per level."""
    level: dict[str, int] = {}
    for name, f in found.items():
        deepest = max((level.get(n, 0) for n in f.needs), default=0)
        level[name] = deepest + (1 if f.scan else 0)
    back: dict[str, int] = {}
    skip: dict[int, int] = {}
    for at in range(max(level.values(), default=0) + 1):
        scans = [n for n in found if level[n] == at and found[n].scan]
        if scans:
            skip[at] = max(back.get(found[n].scan.x, 0) for n in scans)
        for name, f in found.items():
            if level[name] == at:
                before = max((back.get(n, 0) for n in f.needs), default=0)
                back[name] = skip[at] if f.scan else f.back + before
    return level, back, skip


def _block_rows(found: dict[str, Feature], reach: int) -> int:
    """Rows per block: copies stay a small share, and powers stay inside a double."""
    rows = SMALL_BLOCK if reach <= SMALL_BLOCK // 8 else min(8 * reach, LARGE_BLOCK)
    rows = max(rows, reach)
    scans = [f.scan for f in found.values() if f.scan]
    if scans:
        rows = max(rows, reach + max(s.seed_at for s in scans) + 1)
    slowest = [-math.log(s.lam) for s in scans if s.kind == "affine" and 0 < s.lam < 1]
    if slowest:
        rows = min(rows, int(2 * MAX_EXPONENT / max(slowest)) - reach)
    return rows


def _check(rows: int, found: dict[str, Feature], reach: int) -> None:
    for f in found.values():
        if f.scan is None:
            continue
        if rows < reach + f.scan.seed_at + 1:
            raise ValueError(f"{f.name} needs blocks of more than {reach + f.scan.seed_at} rows, not {rows}")
        if f.scan.kind == "affine" and 0 < f.scan.lam < 1:
            if (rows + reach) * -math.log(f.scan.lam) / 2 > MAX_EXPONENT * 1.01:
                raise ValueError(f"{f.name} needs blocks smaller than {rows} rows")


def _fits(names: list[str], own: dict[str, Feature], columns: list[str]) -> bool:
    """Whether one block size serves all of these features."""
    found = gather(names, own, columns)
    reach = max(0, *_levels(found)[1].values()) if found else 0
    try:
        _check(_block_rows(found, reach), found, reach)
    except ValueError:
        return False
    return True


def _tilings(names: list[str], own: dict[str, Feature], columns: list[str]) -> list[list[str]]:
    """The features in groups that can share a block size; one group where they all can."""
    if _fits(names, own, columns):
        return [names]
    groups: list[list[str]] = []
    for name in names:
        group = next((g for g in groups if _fits([*g, name], own, columns)), None)
        if group is None:
            groups.append([name])
        else:
            group.append(name)
    return groups


def looked_back(names: list[str], own: dict[str, Feature], columns: list[str]) -> int:
    """The most earlier rows that windows of these features look at, recurrences aside."""
    found = gather(names, own, columns)
    return max(0, *_levels(found)[1].values()) if found else 0


def rows_needed(names: list[str], columns: list[str], own: list[Feature] = ()) -> int | None:
    """How many earlier bars of its symbol decide a bar's features; None where the whole past does."""
    found = gather(names, {f.name: f for f in own}, [*columns, "rn"])
    if any(f.scan or "rn" in f.needs for f in found.values()):
        return None
    return looked_back(names, {f.name: f for f in own}, [*columns, "rn"])


def features(
    bars: DataFrame,
    names: list[str],
    bar_seconds: int,
    block_rows: int | None = None,
    own: list[Feature] = (),
    keep: list[str] | None = None,
) -> DataFrame:
    """`bars` with the wanted feature columns.

    bar_seconds: bar length, which bounds the rows of a time bucket.
    block_rows: rows per block; chosen from the features when not given.
    own: extra feature rules, used before the named ones.
    keep: input columns to keep (all when not given).

    A table that already holds `rn` is not numbered again. Features that need a recurrence
    store the numbered bars once in the shared folder, as they are read once per level.
    Features that cannot share a block size are formed one group after the other.
    """
    columns = bars.columns
    keep = list(columns) if keep is None else keep
    rules = {f.name: f for f in own}
    found = gather(names, rules, columns + ["rn"])
    wanted = [*keep, *[n for n in names if n not in keep]]
    ordered = any(f.windowed or f.scan or "rn" in f.needs for f in found.values())
    frame = Frame()
    if not ordered:
        return _add_layers(bars, list(found), found, frame).select(*[q(c) for c in wanted])

    groups = [names] if block_rows else _tilings(names, rules, columns + ["rn"])
    if len(groups) > 1:
        table = bars if "rn" in columns else stage(number_rows(bars, bar_seconds), "numbered")
        for group in groups[:-1]:
            table = stage(features(table, group, bar_seconds, own=own), "tiling")
        return features(table, groups[-1], bar_seconds, own=own).select(*[q(c) for c in wanted])

    level, back, skip = _levels(found)
    reach = max(max(back.values(), default=0), 0)
    rows = block_rows or _block_rows(found, reach)
    _check(rows, found, reach)

    inputs = [c for c in columns if c in keep or any(c in f.needs for f in found.values())]
    inputs = list(dict.fromkeys([*KEYS, *[c for c in inputs if c != "rn"]]))
    numbered = bars.select(*[q(c) for c in inputs + ["rn"]]) if "rn" in columns else number_rows(
        bars.select(*[q(c) for c in inputs]), bar_seconds
    )
    deepest = max(level.values(), default=0)
    if deepest and "rn" not in columns:
        numbered = stage(numbered, "numbered")
    laid = lay_out(numbered, rows, back=reach)

    for at in range(deepest + 1):
        if at:
            scans = {n: found[n].scan for n in found if level[n] == at and found[n].scan}
            tiling = Tiling(rows, reach, skip[at])
            # The states feed every later level, so all but the last are stored.
            store = (lambda t: stage(t, "states")) if at < deepest else (lambda t: t)
            laid = run_scans(laid, scans, tiling, frame, store)
        layer = [n for n in found if level[n] == at and not found[n].scan]
        laid = _add_layers(laid, layer, found, frame)
    return laid.where(own_row(rows)).select(*[q(c) for c in wanted])


def _add_layers(df: DataFrame, names: list[str], found: dict[str, Feature], frame: Frame) -> DataFrame:
    """Add expressions, all columns of one depth at a time, so that they share a window pass."""
    depth: dict[str, int] = {}
    for name in names:
        depth[name] = 1 + max((depth.get(n, 0) for n in found[name].needs), default=0)
    for d in sorted(set(depth.values())):
        df = df.withColumns({n: found[n].make(frame) for n in names if depth[n] == d})
    return df


def moving_average(
    bars: DataFrame, column: str, periods: int | list[int], bar_seconds: int, ma_type: str = "SMA", **options
) -> DataFrame:
    """Add `sma_{n}` or `ema_{n}` of any column."""
    build = {"SMA": registry.sma_of, "EMA": registry.ema_of}.get(ma_type)
    if build is None:
        raise ValueError("moving average type must be 'SMA' or 'EMA'")
    periods = periods if isinstance(periods, list) else [periods]
    own = [build(column, n, f"{ma_type.lower()}_{n}") for n in periods]
    return features(bars, [f.name for f in own], bar_seconds, own=own, **options)


def dynamic(
    bars: DataFrame, bar_seconds: int, sma_periods: list[int] = (9, 21, 50), rsi_period: int = 14, **options
) -> DataFrame:
    """SMA columns and one RSI column of the given periods."""
    names = [f"sma_{p}" for p in sma_periods] + [f"rsi_{rsi_period}"]
    return features(bars, names, bar_seconds, **options)


def add_quotes(bars: DataFrame, quotes: DataFrame) -> DataFrame:
    """Current bid and ask of the symbol on every bar, and their mean; one quote per symbol."""
    joined = bars.join(quotes.select("symbol", "bid", "ask"), "symbol", "left")
    return joined.withColumn("last_price", (F.col("bid") + F.col("ask")) / 2)
