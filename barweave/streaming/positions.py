"""Position per symbol as streaming state, with the rules of the batch ledger."""

from __future__ import annotations

from collections.abc import Iterator
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barweave import schema as S

OUTPUT = (
    "symbol string, time timestamp, close double, signal int, state string, entry_price double, "
    "exit_price double, pnl double, realized_pnl double, unrealized_pnl double, trade_id long"
)
# Position, entry price, quantity, profit so far, trades so far, local day and lateness of the last bar.
STATE = "side int, entry double, quantity double, realized double, trades long, day int, late boolean"


def position_stream(
    signals: DataFrame,
    spread: float = S.SPREAD,
    trade_value: float = S.LIVE_TRADE_VALUE,
    leverage: float = S.LEVERAGE,
    close_at: str | None = S.CLOSE_AT,
    time_zone: str = S.TIME_ZONE,
) -> DataFrame:
    """What happens on every bar of a stream of signals(symbol, time, close, signal).

    The state of a symbol is a few numbers; a trigger brings each symbol the bars of one
    trigger. The spread is taken at the entry only. `realized_pnl` adds up closed trades,
    `unrealized_pnl` values the open one.
    """
    stake = trade_value * leverage
    zone = ZoneInfo(time_zone)

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        side, entry, quantity, realized, trades, day, late = (
            state.get if state.exists else (0, 0.0, 0.0, 0.0, 0, 0, False)
        )
        rows = pd.concat(list(batches)).sort_values("time")
        out = []
        for time, close, signal in zip(rows["time"], rows["close"], rows["signal"]):
            reset = False
            if close_at is not None:
                local = time.tz_localize("UTC").astimezone(zone) if time.tzinfo is None else time.astimezone(zone)
                now_late = local.strftime("%H:%M:%S") >= close_at
                reset = now_late and not (late and day == local.toordinal())
                day, late = local.toordinal(), now_late
            entered = left = None
            profit = open_value = 0.0
            name = S.FLAT
            if side == 0 and signal and not reset:
                side, entry = int(signal), close + signal * spread
                quantity, trades, entered = stake / entry, trades + 1, entry
                name = S.OPEN_LONG if side == 1 else S.OPEN_SHORT
                trade = trades
            elif side and (reset or signal == -side):
                left, profit = close, quantity * (close - entry) * side
                realized += profit
                name = S.CLOSE_TIME if reset else (S.CLOSE_LONG if side == 1 else S.CLOSE_SHORT)
                side, trade = 0, trades
            elif side:
                open_value = quantity * (close - entry) * side
                name = S.HOLD_LONG if side == 1 else S.HOLD_SHORT
                trade = trades
            else:
                trade = None
            out.append(
                (key[0], time, close, signal, name, entered, left, profit, realized, open_value, trade)
            )
        state.update((side, entry, quantity, realized, trades, day, late))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])
        frame["trade_id"] = frame["trade_id"].astype("Int64")
        yield frame

    return (
        signals.select("symbol", "time", "close", F.col("signal").cast("int").alias("signal"))
        .groupBy("symbol")
        .applyInPandasWithState(advance, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
    )


def alerts(positions: DataFrame) -> DataFrame:
    """Rows to tell someone about: openings and closings, with a ready text."""
    events = [S.OPEN_LONG, S.OPEN_SHORT, *S.CLOSED]
    text = F.concat_ws(
        " ",
        F.col("symbol"),
        F.col("state"),
        F.format_string("%.4f", F.coalesce("entry_price", "exit_price")),
        F.when(F.col("state").isin(S.CLOSED), F.format_string("%.2f (%.2f)", "pnl", "realized_pnl")),
    )
    return positions.where(F.col("state").isin(events)).select("symbol", "time", "state", text.alias("message"))
