"""Time the headline queries: one JSON line on standard output.

BENCH_SF_DIR and BENCH_CPUS choose data and cores. `python bench.py nominal` instead times
the load the project is meant for: 20 symbols of 52 500 bars, and one long symbol.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

from barweave.catalog import load_queries
from barweave.operators.ledger import ledger
from barweave.operators.reports import daily_results
from barweave.plans.features import features
from barweave.plans.registry import SETS, set_columns
from barweave.session import local_session, stage

HEADLINE = [
    "five_minute_bars",
    "sma",
    "ema",
    "hull",
    "rsi",
    "macd",
    "adx",
    "obv_means",
    "ulcer",
    "hurst",
    "expected_shortfall",
    "market_risk",
    "all_feature_sets",
    "reversal_label",
    "ledger_of_labels",
    "daily_results",
    "stratified_split",
    "permutation_importance",
    "stream_bars",
]


def timed(build) -> float:
    start = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def session():
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"), "spark.sql.shuffle.partitions": cpus}
    return local_session(cpus, "barweave-bench", **conf)


def headline() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session()
    queries = load_queries()
    queries["hourly_bars"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {name: timed(lambda: queries[name](spark, folder)) for name in HEADLINE}
    line = {
        "metric": "headline_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


def made_bars(spark, symbols: int, rows: int):
    """Deterministic bars of a bounded price wave, five minutes apart."""
    i, s = F.col("id") % rows, F.floor(F.col("id") / rows)
    noise = (F.pmod(F.xxhash64("id"), F.lit(1000)) - 500) / 1000
    close = F.round(100 + s + 10 * F.sin(i / 97) + 5 * F.sin(i / 13) + noise, 2)
    wide = F.round(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100)) / 100, 2)
    table = spark.range(0, symbols * rows, 1, 16).select(
        F.format_string("S%02d", s).alias("symbol"),
        F.timestamp_seconds(1_500_000_000 + i * 300).alias("time"),
        close.alias("close"),
        wide.alias("_w"),
        (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(900)) + 1).alias("tick_volume"),
    )
    return stage(
        table.select(
            "symbol", "time", F.col("close").alias("open"), (F.col("close") + F.col("_w")).alias("high"),
            (F.col("close") - F.col("_w")).alias("low"), "close", "tick_volume",
        ),
        "made",
    )


def nominal() -> None:
    spark = session()
    many, long = made_bars(spark, 20, 52_500), made_bars(spark, 1, 5_000_000)
    timed(lambda: features(many.limit(1000), ["sma_9", "ema_9"], 300))
    signal = (F.pmod(F.xxhash64("symbol", "time"), F.lit(40)).isin(0, 1).cast("int") * (F.pmod(F.hash("time"), F.lit(2)) * 2 - 1))
    signals = many.select("symbol", "time", "close", signal.cast("int").alias("signal"))
    every = [n for n in set_columns(list(SETS))]
    result = {
        "all_sets_20x52500": timed(lambda: features(many, every, 300)),
        "core_set_20x52500": timed(lambda: features(many, SETS["core"], 300)),
        "ledger_daily_20x52500": timed(lambda: daily_results(ledger(signals, 300))),
        "ema_200_1x5000000": timed(lambda: features(long, ["ema_200"], 300)),
        "sma_9_obv_1x5000000": timed(lambda: features(long, ["sma_9", "obv"], 300)),
    }
    print(json.dumps({"metric": "nominal", "value": round(sum(result.values()), 3), "unit": "sec", "queries": result}))


if __name__ == "__main__":
    nominal() if sys.argv[1:] == ["nominal"] else headline()
