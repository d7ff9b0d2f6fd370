import numpy as np
import pandas as pd
import pytest
from loops import NAN, adf, exact_adf, expected, rolling, walk
from pyspark.sql import functions as F

from barweave.operators.unit_root import adf_statistics, rolling_adf
from barweave.plans.features import features, moving_average
from barweave.plans.registry import SETS, resolve, set_columns
from barweave.schema import BAR

SECONDS = 300
NAMES = list(expected(walk("A", 300, 0)))


@pytest.fixture(scope="module")
def bars_frame():
    return pd.concat([walk("A", 1500, 1), walk("B", 700, 2), walk("C", 20, 3), walk("D", 1, 4)])


@pytest.fixture(scope="module")
def bars(spark, bars_frame):
    shuffled = bars_frame.sample(frac=1.0, random_state=5)
    return spark.createDataFrame(shuffled).repartition(5)


def by_symbol(table):
    frame = table.toPandas().sort_values(["symbol", "time"])
    return {s: g.reset_index(drop=True) for s, g in frame.groupby("symbol")}


@pytest.mark.parametrize("block_rows", [460, 900])
def test_features_equal_row_loops_over_many_blocks(bars, bars_frame, block_rows):
    got = by_symbol(features(bars, NAMES, SECONDS, block_rows=block_rows))
    for symbol in ("A", "B"):
        want = expected(bars_frame[bars_frame.symbol == symbol])
        for name, values in want.items():
            np.testing.assert_allclose(
                got[symbol][name].to_numpy(float), values, rtol=1e-8, atol=1e-8, err_msg=f"{symbol} {name}"
            )


def test_short_blocks_need_many_carries(bars, bars_frame):
    """A long average over blocks much shorter than its memory."""
    got = by_symbol(features(bars, ["ema_50", "rsi_14", "obv", "vwap"], SECONDS, block_rows=53))
    from loops import ema, obv, rsi

    b = bars_frame[bars_frame.symbol == "A"].sort_values("time")
    c = b.close.to_numpy()
    np.testing.assert_allclose(got["A"].ema_50.to_numpy(float), ema(c, 50), rtol=1e-10)
    np.testing.assert_allclose(got["A"].rsi_14.to_numpy(float), rsi(c, 14), rtol=1e-9)
    cols = pd.Series({"close": c, "tick_volume": b.tick_volume.to_numpy(float)})
    np.testing.assert_allclose(got["A"].obv.to_numpy(float), obv(cols))


def test_too_small_blocks_are_refused(bars):
    with pytest.raises(ValueError):
        features(bars, ["sma_200"], SECONDS, block_rows=100)
    with pytest.raises(ValueError):
        features(bars, ["ema_200"], SECONDS, block_rows=100)


def test_short_series_have_no_long_averages(bars):
    got = by_symbol(features(bars, ["sma_21", "ema_21", "sma_5", "log_ret"], SECONDS))
    assert got["C"].sma_21.isna().all() and got["C"].ema_21.isna().all()
    assert got["C"].sma_5.notna().sum() == 16
    assert got["D"].log_ret.isna().all()


def test_past_does_not_depend_on_future(spark, bars_frame):
    names = set_columns(["core", "momentum", "volume", "crossover", "extra"])
    a = bars_frame[bars_frame.symbol == "B"].sort_values("time").reset_index(drop=True)
    b = a.copy()
    for c in ("open", "high", "low", "close"):
        b.loc[500:, c] = b.loc[500:, c] * 2
    one = features(spark.createDataFrame(a), names, SECONDS).toPandas().sort_values("time")
    two = features(spark.createDataFrame(b), names, SECONDS).toPandas().sort_values("time")
    for n in names:
        x, y = one[n].to_numpy(float)[:500], two[n].to_numpy(float)[:500]
        np.testing.assert_allclose(x, y, rtol=1e-9, atol=1e-9, err_msg=n)


def test_ranges(bars):
    names = "rsi_14 mfi_14 stoch_k stoch_d williams_r_14 bb_upper20 bb_lower20 drawdown cum_max".split()
    t = features(bars, names, SECONDS).toPandas()
    for n in ("rsi_14", "mfi_14", "stoch_k", "stoch_d"):
        assert t[n].dropna().between(-1e-9, 100 + 1e-9).all()
    assert t.williams_r_14.dropna().between(-100 - 1e-9, 1e-9).all()
    assert (t.bb_upper20.dropna() >= t.bb_lower20.dropna()).all()
    assert (t.drawdown >= 0).all() and (t.cum_max >= t.close).all()


def test_flat_prices_and_zero_volume(spark):
    flat = walk("F", 120, 9)
    for c in ("open", "high", "low", "close"):
        flat[c] = 10.0
    flat["tick_volume"] = 0
    names = set_columns([s for s in SETS])
    t = features(spark.createDataFrame(flat), names, SECONDS).toPandas().sort_values("time")
    assert len(t) == 120
    numbers = t[names].to_numpy(float)
    assert not np.isinf(numbers).any()
    assert (t.rsi_14.dropna() == 0).all() and (t.cci_14.dropna() == 0).all()
    assert t.vwap.isna().all() and t.hurst_30.isna().all() and t.sharpe_ratio.isna().all()


def test_empty_input(spark):
    t = features(spark.createDataFrame([], BAR), ["sma_9", "ema_9", "obv"], SECONDS)
    assert t.count() == 0 and "obv" in t.columns


def test_moving_average_of_any_column(bars, bars_frame):
    from loops import ema

    t = moving_average(bars, "high", [3, 10], SECONDS, ma_type="EMA").where("symbol = 'A'").toPandas()
    high = bars_frame[bars_frame.symbol == "A"].sort_values("time").high.to_numpy()
    np.testing.assert_allclose(t.sort_values("time").ema_10.to_numpy(float), ema(high, 10))
    with pytest.raises(ValueError):
        moving_average(bars, "high", 3, SECONDS, ma_type="XMA")


def test_unknown_feature(bars):
    assert resolve("no_such_feature") is None
    with pytest.raises(ValueError):
        features(bars, ["no_such_feature"], SECONDS)


def test_plan_reads_needed_columns_and_windows_blocks(spark, bars, tmp_path):
    path = str(tmp_path / "bars")
    bars.write.parquet(path)
    table = features(spark.read.parquet(path), ["sma_9", "rsi_14"], SECONDS, keep=["symbol", "time"])
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "tick_volume" not in plan and "Python" not in plan
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("blk" in line or "_grp" in line for line in windows)


def test_augmented_dickey_fuller(bars, bars_frame):
    got = by_symbol(rolling_adf(bars, SECONDS, block_rows=100))
    c = bars_frame[bars_frame.symbol == "B"].sort_values("time").close.to_numpy()[:300]
    np.testing.assert_allclose(
        got["B"].adf_stat_30.to_numpy(float)[:300], rolling(c, 30, adf), rtol=1e-5, atol=1e-6
    )
    assert got["C"].adf_stat_30.isna().all()


def test_dickey_fuller_of_a_steep_trend_and_of_dependent_columns():
    """Deviations a ten-millionth of the steps keep their digits; windows without independent columns still get an answer."""
    noise = np.random.default_rng(4).normal(size=34)
    windows = np.lib.stride_tricks.sliding_window_view(50000 + 3.0 * np.arange(34) + 1e-6 * noise, 30)
    np.testing.assert_allclose(adf_statistics(windows), [exact_adf(w) for w in windows], rtol=1e-6)
    windows = np.lib.stride_tricks.sliding_window_view(100 + noise.cumsum(), 30)
    np.testing.assert_allclose(adf_statistics(windows), [exact_adf(w) for w in windows], rtol=1e-9)
    step = np.r_[np.zeros(15), np.ones(15)]
    assert np.isfinite(adf_statistics(np.stack([step + 1, step * 5]))).all() and np.isnan(adf_statistics(np.ones((1, 30)))).all()


def test_nan_prices_become_missing(spark):
    from barweave.sources.bars import missing_to_null

    frame = walk("N", 40, 11)
    frame.loc[20, "close"] = NAN
    t = features(missing_to_null(spark.createDataFrame(frame)), ["sma_5"], SECONDS).orderBy("time").toPandas()
    assert t.sma_5.isna().to_numpy()[20:25].all() and t.sma_5.notna().to_numpy()[25]
    assert t.sma_5.isna().sum() == 4 + 5


def test_number_rows_ranks_across_buckets(bars, bars_frame):
    from barweave.operators.blocks import last_rows, number_rows

    for rows in (7, 4096):
        got = by_symbol(number_rows(bars, SECONDS, rows_per_bucket=rows))
        for g in got.values():
            assert (g.rn.to_numpy() == np.arange(len(g))).all()
    newest = by_symbol(last_rows(bars, 13, SECONDS))
    assert [len(newest[s]) for s in "ABCD"] == [13, 13, 13, 1]
    assert newest["A"].time.max() == bars_frame[bars_frame.symbol == "A"].time.max()


def test_decayed_sums_equal_a_loop(spark):
    from barweave.operators.scan import decayed, group_blocks

    rates = {"slow": 2.56, "middle": 20.0, "fast": 300.0, "faster": 1100.0}
    rng = np.random.default_rng(5)
    states = pd.DataFrame({n: rng.lognormal(0, 3, 9000) for n in rates})
    states.loc[100:8000, "slow"] = 0.0
    states["symbol"], states["blk"] = "A", range(9000)
    got = decayed(spark.createDataFrame(states), rates, strip=1).toPandas().sort_values("blk")
    assert got.blk.tolist() == list(range(9000))
    for name, rate in rates.items():
        want, state = [], 0.0
        for value in states[name]:
            want.append(state)
            state = state * np.exp(-rate) + value
        np.testing.assert_allclose(got[name].fillna(0), want, rtol=1e-9, atol=1e-300, err_msg=name)
    for rate in (0.01, 0.5, 2.56, 20.0, 93.0, 124.0, 186.0, 300.0, 745.0, 746.0, 1190.0):
        size = group_blocks(rate)
        assert size * rate >= 746 and (size == 1 or (size - 1) * rate <= 1200)


def test_newest_rows_prune_the_scan(spark, bars, bars_frame, tmp_path):
    from barweave.operators.blocks import last_rows

    path = str(tmp_path / "bars")
    bars.sortWithinPartitions("time").write.parquet(path)
    newest = last_rows(spark.read.parquet(path), 13, SECONDS, rows_per_bucket=32)
    got = newest.toPandas()
    for symbol, rows in bars_frame.groupby("symbol"):
        want = rows.time.sort_values().tail(13).tolist()
        assert got[got.symbol == symbol].time.sort_values().tolist() == want
    scans = [p for p in newest._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in p]
    assert any("time" in p.split("DataFilters")[1].split("Format")[0] and "ubquery" in p for p in scans)
    assert last_rows(bars.limit(0), 13, SECONDS).count() == 0


def test_repeated_times_are_numbered_by_value(spark, bars_frame):
    from barweave.operators.blocks import number_rows

    frame = pd.concat([bars_frame[bars_frame.symbol == "C"]] * 2).reset_index(drop=True)
    frame["close"] = np.arange(len(frame), dtype=float)
    one = number_rows(spark.createDataFrame(frame), SECONDS).toPandas().sort_values("rn")
    two = number_rows(spark.createDataFrame(frame.iloc[::-1]), SECONDS).toPandas().sort_values("rn")
    assert one.rn.tolist() == list(range(len(frame))) and one.close.tolist() == two.close.tolist()


def test_prefix_levels_agree(spark):
    from barweave.operators.blocks import prefix

    rows = spark.range(300).select(
        F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("symbol"), F.col("id").alias("blk"), F.col("id").alias("v")
    )
    small = prefix(rows, ["v"], size=7).orderBy("blk").toPandas()
    large = prefix(rows, ["v"], size=5000).orderBy("blk").toPandas()
    pd.testing.assert_frame_equal(small, large)


@pytest.mark.parametrize("block_rows", [128, 256, 1024])
def test_long_flat_stretch_keeps_the_quotient(spark, block_rows):
    """After moving bars and thousands of flat ones, RSI and ADX are what they were, in any blocks."""
    rng = np.random.default_rng(5)
    close = np.concatenate([100 + np.cumsum(rng.normal(0, 1, 300)), np.zeros(3000)])
    close[300:] = close[299]
    time = pd.date_range("2024-01-01", periods=len(close), freq="5min")
    bars = spark.createDataFrame(
        pd.DataFrame({"symbol": "S", "time": time, "open": close, "high": close, "low": close, "close": close, "tick_volume": 1})
    )
    got = features(bars, ["rsi_14"], 300, block_rows=block_rows).orderBy("time").toPandas()["rsi_14"].to_numpy()
    assert np.allclose(got[300:], got[300], rtol=1e-9, atol=0)


def test_features_of_different_block_sizes(bars, bars_frame):
    """A fast and a slow average, and one whose window is longer than the fast one's blocks, in one call."""
    from loops import ema

    got = by_symbol(features(bars, ["ema_2", "ema_1200", "sma_1400"], SECONDS))["A"]
    close = bars_frame[bars_frame.symbol == "A"].sort_values("time").close.to_numpy()
    np.testing.assert_allclose(got.ema_2.to_numpy(float), ema(close, 2), rtol=1e-9)
    np.testing.assert_allclose(got.ema_1200.to_numpy(float), ema(close, 1200), rtol=1e-9)
    want = pd.Series(close).rolling(1400).mean()
    np.testing.assert_allclose(got.sma_1400.to_numpy(float), want, rtol=1e-9)
