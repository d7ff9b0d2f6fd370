import numpy as np
import pandas as pd
import pytest
from loops import walk
from pyspark.sql import functions as F

from barweave import schema as S
from barweave.catalog.streams import new_folder
from barweave.operators.ledger import ledger
from barweave.sources.bars import bars_from_ticks
from barweave.streaming.bars import bar_stream, read_tick_stream
from barweave.streaming.live import position_batches, read_signals, score_bars, trading_hours, write_stream
from barweave.streaming.positions import alerts, position_stream

SECONDS = 300
ONCE = {"availableNow": True}


@pytest.fixture(scope="module")
def ticks():
    rng = np.random.default_rng(2)
    n = 3000
    return pd.DataFrame(
        {
            "event_id": range(n),
            "ts": pd.Timestamp("2024-05-06 12:00") + pd.to_timedelta(np.sort(rng.integers(0, 30 * 3600, n)), unit="s"),
            "symbol": rng.choice(["A", "B"], n),
            "price": np.round(50 + np.cumsum(rng.normal(0, 0.2, n)), 2),
        }
    )


def write_files(spark, frame, folder, files):
    """Files whose order of arrival is their order in time."""
    for i, part in enumerate(np.array_split(np.arange(len(frame)), files)):
        spark.createDataFrame(frame.iloc[part]).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        assert i < files


@pytest.mark.parametrize("files", [1, 4])
def test_stream_of_bars_equals_batch(spark, ticks, files):
    folder = new_folder(spark)
    doubled = pd.concat([ticks, ticks.iloc[100:110]]).sort_values("ts")
    write_files(spark, doubled, folder, files)
    stream = bar_stream(read_tick_stream(spark, f"{folder}/in", 1), SECONDS)
    write_stream(stream, folder, "bars", ONCE).awaitTermination()
    got = spark.read.parquet(f"{folder}/bars").toPandas().sort_values(["symbol", "time"], ignore_index=True)
    limit = ticks.ts.max() - pd.Timedelta(minutes=15)
    want = bars_from_ticks(spark.createDataFrame(ticks), SECONDS).toPandas()
    want = want[want.time <= limit].sort_values(["symbol", "time"], ignore_index=True)
    pd.testing.assert_frame_equal(got[want.columns], want)


def test_late_ticks_are_dropped(spark, ticks):
    folder = new_folder(spark)
    write_files(spark, ticks, folder, 2)
    stream = bar_stream(read_tick_stream(spark, f"{folder}/in", 1), SECONDS)
    write_stream(stream, folder, "bars", ONCE).awaitTermination()
    before = spark.read.parquet(f"{folder}/bars").agg(F.sum("tick_volume")).first()[0]
    late = ticks.iloc[:5].assign(event_id=lambda t: t.event_id + 100000)
    spark.createDataFrame(late).write.mode("append").parquet(f"{folder}/in")
    stream = bar_stream(read_tick_stream(spark, f"{folder}/in", 1), SECONDS)
    write_stream(stream, folder, "bars", ONCE).awaitTermination()
    assert spark.read.parquet(f"{folder}/bars").agg(F.sum("tick_volume")).first()[0] == before


@pytest.fixture(scope="module")
def signals():
    rng = np.random.default_rng(4)
    b = pd.concat([walk("A", 700, 21), walk("B", 400, 22)])
    b["signal"] = rng.choice([-1, 0, 1], len(b), p=[0.1, 0.8, 0.1]).astype("int32")
    return b[["symbol", "time", "close", "signal"]].sort_values("time", ignore_index=True)


@pytest.fixture(scope="module")
def batch_ledger(spark, signals):
    table = ledger(
        spark.createDataFrame(signals), SECONDS, trade_value=S.LIVE_TRADE_VALUE, exit_spreads=0, close_at=S.CLOSE_AT
    )
    return table.toPandas().sort_values(["symbol", "time"], ignore_index=True)


def same_as_batch(got, batch_ledger):
    got = got.sort_values(["symbol", "time"], ignore_index=True)
    assert list(got.state) == list(batch_ledger.state)
    for c in ("pnl", "entry_price", "exit_price"):
        np.testing.assert_allclose(got[c].to_numpy(float), batch_ledger[c].to_numpy(float), rtol=1e-9)
    np.testing.assert_array_equal(got.trade_id.to_numpy(float), batch_ledger.trade_id.to_numpy(float))
    held = batch_ledger.state.isin([S.HOLD_LONG, S.HOLD_SHORT])
    np.testing.assert_allclose(got.unrealized_pnl[held], batch_ledger.running_pnl[held], rtol=1e-9)


def feed(spark, signals, folder, files):
    """One run per file, so that each file is a batch of its own."""
    for i, part in enumerate(np.array_split(np.arange(len(signals)), files)):
        table = spark.createDataFrame(signals.iloc[part]).withColumn("signal", F.col("signal").cast("int"))
        table.coalesce(1).write.parquet(f"{folder}/signals/batch={i}")
        yield


@pytest.mark.parametrize("files", [1, 3])
def test_keyed_positions_equal_batch_ledger(spark, signals, batch_ledger, files):
    folder = new_folder(spark)
    for _ in feed(spark, signals, folder, files):
        stream = position_stream(read_signals(spark, folder))
        write_stream(stream, folder, "positions", ONCE).awaitTermination()
    got = spark.read.parquet(f"{folder}/positions").toPandas()
    same_as_batch(got, batch_ledger)
    got = got.sort_values(["symbol", "time"])
    np.testing.assert_allclose(got.groupby("symbol").pnl.cumsum(), got.realized_pnl, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("files", [1, 4])
def test_positions_by_blocks_equal_batch_ledger(spark, signals, batch_ledger, files):
    folder = new_folder(spark)
    for _ in feed(spark, signals, folder, files):
        position_batches(read_signals(spark, folder), folder, SECONDS, trigger=ONCE).awaitTermination()
    got = spark.read.parquet(f"{folder}/positions").toPandas().sort_values(["symbol", "time"])
    same_as_batch(got, batch_ledger)
    np.testing.assert_allclose(got.groupby("symbol").pnl.cumsum(), got.realized_pnl, rtol=1e-9, atol=1e-9)


def test_alerts(spark, signals):
    folder = new_folder(spark)
    for _ in feed(spark, signals, folder, 1):
        stream = alerts(position_stream(read_signals(spark, folder)))
        write_stream(stream, folder, "alerts", ONCE).awaitTermination()
    got = spark.read.parquet(f"{folder}/alerts").toPandas()
    assert len(got) and not got.state.isin([S.FLAT, S.HOLD_LONG, S.HOLD_SHORT]).any()
    assert got.message.str.contains("A|B").all()


@pytest.mark.parametrize("names", [["sma_diff_9_21"], ["obv", "ema_21", "rsi_14"]])
def test_live_scores_equal_batch(spark, ticks, names):
    """Two arrivals: the second sees what the features need of the first, all of it for recurrences."""
    from barweave.plans.features import features

    def score(bars):
        t = features(bars, names, SECONDS, keep=["symbol", "time", "close"])
        parts = [F.coalesce(F.round(n, 6).cast("string"), F.lit("")) for n in names]
        return t.withColumn("signal", F.hash(*parts))

    folder = new_folder(spark)
    half = len(ticks) // 2
    for part in (ticks.iloc[:half], ticks.iloc[half:]):
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = bar_stream(read_tick_stream(spark, f"{folder}/in", 1), SECONDS)
        score_bars(stream, folder, score, SECONDS, names, trigger=ONCE).awaitTermination()
    got = spark.read.option("recursiveFileLookup", True).parquet(f"{folder}/signals").toPandas()
    want = score(bars_from_ticks(spark.createDataFrame(ticks), SECONDS)).fillna({"signal": 0}).toPandas()
    want = want[want.time <= ticks.ts.max() - pd.Timedelta(minutes=15)]
    both = got.merge(want, on=["symbol", "time"], how="outer", suffixes=("", "_batch"))
    assert len(got) == len(want) == len(both) and (both.signal == both.signal_batch).all()


def test_trading_hours(spark):
    times = ["2024-05-06 02:59:59", "2024-05-06 03:00:00", "2024-05-06 22:55:00", "2024-05-06 22:55:01"]
    table = spark.createDataFrame(pd.DataFrame({"time": pd.to_datetime(times)}))
    kept = [str(r.time) for r in trading_hours(table).collect()]
    assert kept == ["2024-05-06 03:00:00", "2024-05-06 22:55:00"]


RECURRENT = ["obv", "ema_21", "rsi_14", "macd_signal", "adx_14", "cum_max", "ulcer_index", "adl", "vwap", "sma_9", "vw_rsi"]


def test_features_from_state_equal_batch_and_read_no_old_bars(spark):
    """Many small batches: symbols that start late, pause, and have few rows; every old bar file is gone before the next batch."""
    import shutil

    from barweave.plans.features import features
    from barweave.streaming.live import feature_batches

    names = RECURRENT
    a, b, c = walk("A", 420, 1), walk("B", 300, 2), walk("C", 12, 3)
    whole = pd.concat([a, b, c], ignore_index=True)
    cuts = {"A": np.array([60, 330, 333]), "B": np.array([0, 280, 280]), "C": np.array([3, 3, 8])}
    folder = new_folder(spark)
    rows = spark.createDataFrame(whole)
    for i in range(4):
        parts = [g.iloc[(cuts[s][i - 1] if i else 0) : (cuts[s][i] if i < 3 else None)] for s, g in whole.groupby("symbol")]
        part = pd.concat(parts, ignore_index=True)
        path = f"{folder}/in/part={i}"
        spark.createDataFrame(part, rows.schema).coalesce(1).write.parquet(path)
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(f"{folder}/in")
        feature_batches(stream, folder, names, SECONDS, trigger=ONCE).awaitTermination()
        shutil.rmtree(path.removeprefix("file:"))
    got = spark.read.option("recursiveFileLookup", True).parquet(f"{folder}/features").toPandas().sort_values(["symbol", "time"], ignore_index=True)
    want = features(rows, names, SECONDS).toPandas().sort_values(["symbol", "time"], ignore_index=True)
    assert len(got) == len(want)
    for n in names:
        np.testing.assert_allclose(got[n].to_numpy(float), want[n].to_numpy(float), rtol=1e-9, atol=1e-9, err_msg=n)
