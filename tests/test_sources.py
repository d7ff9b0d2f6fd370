import pandas as pd
import pytest
from loops import walk
from pyspark.sql import functions as F

from barweave.catalog.streams import new_folder
from barweave.plans.job import build_features, run_features
from barweave.sources.bars import from_epoch, from_text, read_bars, volume_column, write_bars


@pytest.fixture(scope="module")
def bars(spark):
    frame = pd.concat([walk("A", 400, 1), walk("B", 350, 2)]).assign(spread=0.01)
    return spark.createDataFrame(frame)


@pytest.mark.parametrize("format", ["parquet", "csv"])
def test_round_trip(spark, bars, format):
    path = f"{new_folder(spark)}/bars"
    write_bars(bars, path, "M5", format)
    back = read_bars(spark, path, format)
    assert back.exceptAll(bars.select(*back.columns)).count() == 0 and back.count() == 750
    newest = read_bars(spark, path, format, ["B"], num_candles=10)
    assert newest.count() == 10 and newest.agg(F.max("time")).first()[0] == bars.where("symbol = 'B'").agg(F.max("time")).first()[0]
    assert read_bars(spark, path, format, ["Z"]).count() == 0


def test_bad_requests_fail_at_once(spark):
    for symbols in ([], [""], [5]):
        with pytest.raises(ValueError):
            read_bars(spark, "/nowhere", symbols=symbols)
    with pytest.raises(ValueError):
        read_bars(spark, "/nowhere", num_candles=0)


def test_times(spark):
    row = from_epoch(spark.sql("SELECT 1714990000L AS time")).first()
    assert str(row.time) == "2024-05-06 10:06:40"
    assert from_text(spark.sql("SELECT '2024-05-06 10:06:40' AS time")).first().time == row.time


def test_volume_column(spark):
    table = spark.sql("SELECT 5 AS volume")
    assert volume_column(table).first().tick_volume == 5
    both = spark.sql("SELECT 5 AS volume, 7L AS tick_volume")
    assert volume_column(both).first().tick_volume == 7


def test_feature_job(spark, bars):
    folder = new_folder(spark)
    write_bars(bars, f"{folder}/bars", "M5")
    run_features(
        spark, f"{folder}/bars", f"{folder}/out", "M5", 300, frame_period=390, sets=["basic", "crossover"], adf=True, wavelet=True
    )
    out = spark.read.parquet(f"{folder}/out").toPandas()
    assert out.groupby("symbol").size().to_dict() == {"A": 390 - 199, "B": 350 - 199}
    assert {"adf_stat_30", "wavelet_coeff", "zscore_vol", "spread"} <= set(out.columns)


def test_sets_bring_their_joined_members(spark, bars):
    """adf_stat_30 belongs to the set risk, wavelet_coeff to ml; a flag overrules the set."""
    table = build_features(bars, 300, sets=["risk", "ml"], complete=False)
    assert {"adf_stat_30", "wavelet_coeff", "cum_max", "vol_cluster"} <= set(table.columns) and table.count() == 750
    assert table.where("adf_stat_30 is not null").count() == 750 - 2 * 29
    bare = build_features(bars, 300, sets=["risk", "ml"], adf=False, wavelet=False).columns
    assert not {"adf_stat_30", "wavelet_coeff"} & set(bare)


def test_market_columns_only_with_a_market(spark, bars):
    assert "beta" not in build_features(bars, 300, sets=["basic"]).columns
    market = bars.where("symbol = 'A'").select("time", F.lit(None).cast("double").alias("market_log_ret"))
    table = build_features(bars, 300, sets=["basic"], market=market, complete=False)
    assert table.where("beta is not null").count() == 0 and table.count() == 750
