"""Catalog queries against their SQL. BARWEAVE_ALL=1 runs every query, else a part of them."""

import os

import pytest
from compare import DATA, connect, difference

import __spark_entry__ as entry

SF = "0.001"
PART = """price_features sma ema hull keltner macd adx chaikin_oscillator obv_means mfi hurst dickey_fuller
    expected_shortfall market_risk wavelet newest_bars bar_validation order_intents reversal_label
    ledger_with_session_close trades daily_results recent_statistics results_table stratified_split stream_bars""".split()


@pytest.fixture(scope="module")
def database():
    return connect(SF)


def test_catalog_is_consistent():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and set(PART) <= set(oracle)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("BARWEAVE_ALL") else PART)
def test_query_equals_sql(spark, database, name):
    mine = entry.queries()[name](spark, f"{DATA}/sf{SF}").toPandas()
    assert difference(mine, database.execute(entry.oracle_sql()[name]).df()) is None
