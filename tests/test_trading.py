import datetime as dt

import numpy as np
import pandas as pd
import pytest
from loops import machine, walk
from pyspark.sql import functions as F

from barweave.operators import reports
from barweave.operators.labels import reversal_label
from barweave.operators.ledger import ledger
from barweave.operators.orders import order_intents
from barweave.operators.split import stratified_split
from barweave.operators.states import positions
from barweave.operators.validate import validate

SECONDS = 300


def signals_of(spark, series: dict[str, list[int]]):
    rows = []
    for symbol, values in series.items():
        b = walk(symbol, len(values), len(values), gaps=False)
        rows.append(b.assign(signal=values)[["symbol", "time", "close", "signal"]])
    return pd.concat(rows)


def check(spark, frame, **options):
    got = ledger(spark.createDataFrame(frame.sample(frac=1, random_state=1)), SECONDS, **options).toPandas()
    for symbol, g in got.groupby("symbol"):
        g = g.sort_values("time")
        names, pnl, ids = machine(g.close, g.signal, [False] * len(g))
        assert list(g.state) == names
        np.testing.assert_allclose(g.pnl, pnl, rtol=1e-9, atol=1e-9)
        assert [None if pd.isna(i) else int(i) for i in g.trade_id] == ids


def test_hand_made_states(spark):
    frame = signals_of(spark, {"A": [0, 1, 1, 0, -1, -1, 0, 1, 0]})
    got = ledger(spark.createDataFrame(frame), SECONDS).orderBy("time").toPandas()
    assert list(got.state) == [
        "Sem Operação", "Compra", "Comprado", "Comprado", "Reversão Long",
        "Venda", "Vendido", "Reversão Short", "Sem Operação",
    ]
    first = got.iloc[1]
    assert first.entry_price == pytest.approx(first.close + 0.025)
    closing = got.iloc[4]
    quantity = 20000 / first.entry_price
    assert closing.pnl == pytest.approx(quantity * (closing.close - 0.05 - first.entry_price))
    assert closing.exit_price == pytest.approx(closing.close - 0.025)
    assert got.running_pnl.isna().tolist() == [True] + [False] * 7 + [True]


@pytest.mark.parametrize("block_rows", [4, 16, 1024])
def test_ledger_equals_loop_over_many_blocks(spark, block_rows):
    rng = np.random.default_rng(block_rows)
    series = {
        "dense": rng.choice([-1, 0, 1], 400).tolist(),
        "sparse": rng.choice([-1, 0, 1], 400, p=[0.02, 0.96, 0.02]).tolist(),
        "alternating": [1, -1] * 150,
        "rare": [0] * 150 + [1] + [0] * 200 + [-1] + [0] * 10,
        "none": [0] * 90,
        "one": [1],
        "ones": [1] * 70,
    }
    check(spark, signals_of(spark, series), block_rows=block_rows)


def test_position_levels_agree(spark):
    rng = np.random.default_rng(3)
    rows = [("s", i, int(v), bool(c)) for i, (v, c) in enumerate(zip(rng.choice([-1, 0, 1], 3000), rng.random(3000) < 0.01))]
    table = spark.createDataFrame(rows, "symbol string, rn long, signal int, reset boolean")
    results = [
        [r.st for r in positions(table, 8, levels).orderBy("rn").select("st").collect()] for levels in (0, 1, 2, 3)
    ]
    state, want = 0, []
    for _, _, s, cut in rows:
        state = 0 if cut else max(-1, min(1, state + s))
        want.append(state)
    assert all(r == want for r in results)


def test_close_at_time_of_day_and_at_end(spark):
    start = dt.datetime(2024, 5, 6, 19, 0)  # 16:00 in Sao Paulo
    frame = pd.DataFrame(
        {
            "symbol": "A",
            "time": [start + dt.timedelta(minutes=30 * i) for i in range(12)],
            "close": np.linspace(10, 12, 12),
            "signal": [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0],
        }
    )
    got = ledger(spark.createDataFrame(frame), SECONDS, close_at="17:55:00").orderBy("time").toPandas()
    assert list(got.state[:7]) == [
        "Compra", "Comprado", "Comprado", "Comprado", "Fechado Horário", "Compra", "Comprado",
    ]
    ended = ledger(spark.createDataFrame(frame), SECONDS, close_at_end=True).orderBy("time").toPandas()
    assert ended.state.iloc[-1] == "Fechado Horário" and ended.pnl.iloc[-1] > 0


def test_reports_add_up(spark):
    rng = np.random.default_rng(8)
    frame = signals_of(spark, {"A": rng.choice([-1, 0, 1], 900).tolist(), "B": rng.choice([-1, 0, 1], 600).tolist()})
    book = ledger(spark.createDataFrame(frame), SECONDS).cache()
    total = book.groupBy("symbol").agg(F.sum("pnl").alias("p")).orderBy("symbol").toPandas().p.to_numpy()
    daily = reports.daily_results(book)
    for table, column in (
        (daily, "total_profit_loss"),
        (reports.monthly_results(book), "total_profit_loss"),
        (reports.trades(book), "pnl"),
    ):
        sums = table.groupBy("symbol").agg(F.sum(column).alias("p")).orderBy("symbol").toPandas().p.to_numpy()
        np.testing.assert_allclose(sums, total)
    summary = reports.summary(book).orderBy("symbol").toPandas()
    np.testing.assert_allclose(summary.final_capital, 1000 + total)
    np.testing.assert_allclose(summary.roi_pct, total / 10)
    closed = reports.closed_trades(book).toPandas()
    assert (closed.wins + closed.losses > 0).all()
    days = reports.last_days(daily, 1).toPandas()
    assert days.groupby("symbol").size().max() <= 2
    book.unpersist()


@pytest.mark.parametrize("block_rows", [16, None])
def test_label(spark, block_rows):
    b = pd.concat([walk("A", 300, 1), walk("B", 5, 2)])
    got = reversal_label(spark.createDataFrame(b), SECONDS, block_rows=block_rows).toPandas().sort_values("time")
    a = b[b.symbol == "A"].sort_values("time").reset_index(drop=True)
    now, then = a.close.pct_change(), a.close.shift(-9) / a.close - 1
    want = np.where((now < 0) & (then > 0.0035), 1, np.where((now > 0) & (then < -0.0035), -1, 0))[:-9]
    assert set(got.symbol) == {"A"} and list(got.target) == list(want)
    table = spark.createDataFrame(got)
    assert reversal_label(table, SECONDS) is table


def test_validation_keeps_and_rejects(spark):
    b = walk("A", 50, 1)
    b.loc[3, "high"] = b.loc[3, "low"] - 1
    b.loc[4, "low"] = b.loc[4, "high"] + 0.0 + 1e-3
    b.loc[4, "high"] = b.loc[4, "low"] + 1
    b.loc[5, "tick_volume"] = -1
    b.loc[6, "close"] = float("nan")
    b.loc[8, "time"] = b.loc[7, "time"]
    good, bad = validate(spark.createDataFrame(b))
    assert good.count() == 44
    assert sorted(bad.toPandas().reason) == ["high", "low", "missing", "repeated", "repeated", "volume"]
    with pytest.raises(ValueError):
        validate(spark.createDataFrame(b.drop(columns="low")))


def test_order_intents(spark):
    orders = spark.createDataFrame(
        [(1, "A", "buy", 1000.0), (2, "A", "sell", 1000.0), (3, "A", "buy", 1.0)], "order_id long, symbol string, side string, value double"
    )
    quotes = spark.createDataFrame([("A", 9.9, 10.0)], "symbol string, bid double, ask double")
    info = spark.createDataFrame([("A", 1.0)], "symbol string, volume_min double")
    got = {r.order_id: r for r in order_intents(orders, quotes, info).collect()}
    assert (got[1].price, got[1].volume, got[1].magic, got[1].rejected) == (10.0, 100.0, 1000, False)
    assert (got[2].price, got[2].magic, got[2].deviation) == (9.9, 1001, 10)
    assert got[3].rejected


def test_split_is_exact_and_repeatable(spark):
    table = spark.range(5000).select(
        F.when(F.col("id") % 10 == 0, -1).when(F.col("id") % 10 == 1, 1).otherwise(0).alias("target"),
        F.lit("A").alias("symbol"),
        F.timestamp_seconds("id").alias("time"),
    )
    split = stratified_split(table, "target", 0.3)
    counts = {r.target: r["n"] for r in split.where("is_test").groupBy("target").agg(F.count("*").alias("n")).collect()}
    assert counts == {-1: 150, 1: 150, 0: 1200}
    again = stratified_split(table.repartition(7), "target", 0.3)
    both = split.alias("a").join(again.alias("b"), ["symbol", "time"]).where("a.is_test <> b.is_test")
    assert both.count() == 0
    assert stratified_split(table, "target", 0.0).where("is_test").count() == 0
    assert stratified_split(table, "target", 1.0).where("is_test").count() == 5000


@pytest.mark.parametrize("session_zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_local_clock_in_any_session_zone(spark, session_zone):
    from barweave.operators.ledger import local_clock, local_time

    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", session_zone)
        # 2024-03-10 06:30 UTC is inside the night New York's clocks go forward.
        instants = spark.createDataFrame([(1710052200,), (1717271999,), (-1,)], "s long").selectExpr("timestamp_seconds(s) AS time")
        got = instants.select(
            local_clock("time", "America/Sao_Paulo").alias("clock"), local_time("time", "America/Sao_Paulo").cast("date").cast("string").alias("day")
        ).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [tuple(r) for r in got] == [("03:30:00", "2024-03-10"), ("16:59:59", "2024-06-01"), ("20:59:59", "1969-12-31")]
