"""The live job: ticks to bars, bars to scores, scores to positions, all symbols at once.

The streaming queries meet in a table of scored bars, so each keeps its own checkpoint and can
be restarted alone. Positions can be kept per symbol (`positions.position_stream`, for live
triggers with few bars per symbol) or per batch with the block-wise ledger (`position_batches`,
for catching up on a long past, where one symbol may fill most of a batch).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barweave import schema as S
from barweave.operators.ledger import closing_bar, ledger, local_clock
from barweave.operators.scan import Scan
from barweave.plans.features import features, rows_needed
from barweave.plans.registry import Feature
from barweave.sources.bars import last_rows
from barweave.streaming.recurrent import advance, plan

TRIGGER = {"processingTime": "5 minutes"}
SIGNALS = "symbol string, time timestamp, close double, signal int"


def trading_hours(
    df: DataFrame, start: str = S.SESSION_START, end: str = S.SESSION_END, time_zone: str = S.TIME_ZONE
) -> DataFrame:
    """Rows inside the session by local time of day."""
    return df.where(local_clock("time", time_zone).between(start, end))


def rewrite(df: DataFrame, path: str) -> DataFrame:
    """Write over the folder, and read it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_if_there(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """The table, or None before its first write."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def feature_batches(
    bars: DataFrame, folder: str, names: list[str], bar_seconds: int, own: list[Feature] = (), trigger: dict | None = None
) -> StreamingQuery:
    """Append closed bars with the features `names` to `folder`/features, equal to those of the batch code.

    Recurrences go on from `folder`/state: a batch reads its own bars and a bounded number of rows per symbol.
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        done = with_features(batch, batch_id, folder, names, bar_seconds, own)
        rewrite(done, f"{folder}/features/batch={batch_id}")

    return (
        bars.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", f"{folder}/checkpoint-features")
        .trigger(**(trigger or TRIGGER))
        .start()
    )


def with_features(batch: DataFrame, batch_id: int, folder: str, names: list[str], bar_seconds: int, own: list[Feature] = ()) -> DataFrame:
    """The batch's bars with their features; the state after it is written. Two state folders take turns, so a batch
    that runs again still finds what it read."""
    before = read_if_there(batch.sparkSession, f"{folder}/state/{(batch_id - 1) % 2}") if batch_id else None
    steps = plan(names, batch.columns, own)
    done, after = advance(batch, before, steps, bar_seconds, lambda df, name: rewrite(df, f"{folder}/step-{name}"))
    rewrite(after, f"{folder}/state/{batch_id % 2}")
    return done


def score_bars(
    bars: DataFrame,
    folder: str,
    score: Callable[[DataFrame], DataFrame],
    bar_seconds: int,
    names: list[str],
    own: list[Feature] = (),
    trigger: dict | None = None,
) -> StreamingQuery:
    """Append closed bars to `folder`/bars and their signals to `folder`/signals.

    score(bars) returns (symbol, time, close, signal), computed with the batch code from the
    features `names` (`own`: rules of its own, as for `features`). It gets the new bars and the
    earlier bars of each symbol that these features look at; the rows of the new bars are kept.
    Where all features look back a bounded number of bars, `folder`/recent holds just these.
    Recurrences and running totals follow from the whole past: with them the features come ready
    made, from the state of `folder`/state, and `score` sees the new bars alone; a rule of its own
    that looks at earlier bars belongs into `own`. The signals are those of the batch code.
    A batch that runs again overwrites its own folders, so nothing is written twice.
    """
    history = rows_needed(names, bars.columns, own)

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = rewrite(batch, f"{folder}/bars/batch={batch_id}")
        if history is None:
            known = with_features(new, batch_id, folder, names, bar_seconds, own)
        else:
            # Two folders in turn: a batch that runs again still finds what it read.
            before = read_if_there(spark, f"{folder}/recent/{(batch_id - 1) % 2}", batch.schema) if batch_id else None
            known = new if before is None else before.unionByName(new)
            rewrite(last_rows(known, history, bar_seconds), f"{folder}/recent/{batch_id % 2}")
        firsts = new.groupBy("symbol").agg(F.min("time").alias("_from"))
        fresh = score(known).join(firsts, "symbol").where(F.col("time") >= F.col("_from"))
        signal = F.coalesce("signal", F.lit(0)).cast("int").alias("signal")
        rewrite(fresh.select("symbol", "time", "close", signal), f"{folder}/signals/batch={batch_id}")

    return (
        bars.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", f"{folder}/checkpoint-bars")
        .trigger(**(trigger or TRIGGER))
        .start()
    )


def read_signals(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """The scored bars as a stream, for `position_stream`."""
    reader = spark.readStream.schema(SIGNALS).option("recursiveFileLookup", True)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{folder}/signals")


def write_stream(df: DataFrame, folder: str, name: str, trigger: dict | None = None) -> StreamingQuery:
    """Append a stream to the table `folder`/`name`."""
    return (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", f"{folder}/checkpoint-{name}")
        .option("path", f"{folder}/{name}")
        .trigger(**(trigger or TRIGGER))
        .start()
    )


CARRY = (
    "symbol string, last_time timestamp, last_close double, side int, open_time timestamp, "
    "open_close double, trades long, realized double"
)


def position_batches(
    signals: DataFrame,
    folder: str,
    bar_seconds: int,
    spread: float = S.SPREAD,
    trade_value: float = S.LIVE_TRADE_VALUE,
    leverage: float = S.LEVERAGE,
    close_at: str | None = S.CLOSE_AT,
    time_zone: str = S.TIME_ZONE,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Positions of a stream of signals in `folder`/positions, by the batch ledger.

    Between batches only one row per symbol is kept: its last bar, the opening bar of an open
    trade, the number of trades and the profit so far. The opening bar, put before the new
    bars, brings the ledger into the state it had.
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = rewrite(
            batch.select("symbol", "time", "close", F.col("signal").cast("int").alias("signal")),
            f"{folder}/new/batch={batch_id}",
        )
        carry = read_if_there(spark, f"{folder}/carry/batch={batch_id - 1}", CARRY)
        if carry is None:
            carry = spark.createDataFrame([], CARRY)
        rows = new.withColumn("reset", F.lit(False))
        if close_at is not None:
            # The bar before the batch tells whether the first new bar is the day's first late one.
            lasts = carry.select(
                "symbol", F.col("last_time").alias("time"), F.col("last_close").alias("close"), F.lit(0).alias("signal")
            )
            known = lasts.withColumn("old", F.lit(True)).unionByName(new.withColumn("old", F.lit(False)))
            marked = features(known, ["reset"], bar_seconds, own=[closing_bar(close_at, time_zone)])
            rows = marked.where(~F.col("old")).select(*rows.columns)
        openings = carry.where(F.col("side") != 0).select(
            "symbol",
            F.col("open_time").alias("time"),
            F.col("open_close").alias("close"),
            F.col("side").alias("signal"),
            F.lit(False).alias("reset"),
        )
        book = ledger(
            openings.unionByName(rows), bar_seconds, spread, trade_value, leverage, exit_spreads=0
        )
        paid = Feature("_paid", ("pnl",), scan=Scan("pnl", kind="sum"))
        book = features(book, ["_paid"], bar_seconds, own=[paid]).join(carry, "symbol", "left")
        held = F.coalesce("side", F.lit(0)) != 0
        earlier = F.coalesce("trades", F.lit(0)) - held.cast("int")
        moved = book.select(
            *[c for c in ("symbol", "time", "close", "signal", "state", "entry_price", "exit_price", "pnl")],
            (F.coalesce("realized", F.lit(0.0)) + F.col("_paid")).alias("realized_pnl"),
            F.when(F.col("state").isin(S.HOLD_LONG, S.HOLD_SHORT), F.col("running_pnl")).otherwise(0.0).alias("unrealized_pnl"),
            (F.col("trade_id") + earlier).alias("trade_id"),
            (F.coalesce(F.col("time") <= F.col("last_time"), F.lit(False))).alias("old"),
        )
        moved = rewrite(moved, f"{folder}/moved/batch={batch_id}")
        rewrite(moved.where(~F.col("old")).drop("old"), f"{folder}/positions/batch={batch_id}")
        rewrite(_next_carry(moved, carry), f"{folder}/carry/batch={batch_id}")

    return (
        signals.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", f"{folder}/checkpoint-positions")
        .trigger(**(trigger or TRIGGER))
        .start()
    )


def _next_carry(moved: DataFrame, carry: DataFrame) -> DataFrame:
    """The row kept per symbol after a batch; symbols without new bars keep theirs."""
    opened = F.col("state").isin(S.OPEN_LONG, S.OPEN_SHORT)
    opening = F.struct("time", "close", "state")
    now = moved.groupBy("symbol").agg(
        F.max_by(F.struct("time", "close", "state"), "time").alias("_last"),
        F.max_by(F.when(opened, opening), F.when(opened, F.col("time"))).alias("_open"),
        F.max("trade_id").alias("_trades"),
        F.sum("pnl").alias("_realized"),
    )
    open_states = [S.OPEN_LONG, S.OPEN_SHORT, S.HOLD_LONG, S.HOLD_SHORT]
    side = F.when(~F.col("_last.state").isin(open_states), 0).when(
        F.col("_last.state").isin(S.OPEN_LONG, S.HOLD_LONG), 1
    ).otherwise(-1)
    touched = F.col("_last").isNotNull()

    def pick(new, old: str):
        return F.when(touched, new).otherwise(F.col(old)).alias(old)

    return carry.join(now, "symbol", "full").select(
        "symbol",
        pick(F.col("_last.time"), "last_time"),
        pick(F.col("_last.close"), "last_close"),
        pick(side, "side"),
        pick(F.col("_open.time"), "open_time"),
        pick(F.col("_open.close"), "open_close"),
        F.coalesce("_trades", "trades", F.lit(0)).cast("long").alias("trades"),
        (F.coalesce("realized", F.lit(0.0)) + F.coalesce("_realized", F.lit(0.0))).alias("realized"),
    )
