"""Queries on preparing, learning and scoring, with the operators' own trees, depths, repeats and grid."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.catalog.tables import HOUR, MARKET, PLAIN, bars, query, rounded, shown, ticks
from barweave.catalog.trading import labelled
from barweave.operators import reports
from barweave.operators.labels import reversal_label
from barweave.operators.ledger import ledger
from barweave.operators.split import ordered_split, stratified_split
from barweave.plans import ml
from barweave.plans.features import features
from barweave.plans.job import model_table
from barweave.schema import MODEL_FEATURES
from barweave.session import shared_dir, stage
from barweave.sources.bars import latest_quotes, market_returns

NAMES = "close volatility change_percent sma_9 sma_21 roc_5 rsi_14 close_lag1 volume_profile".split()


def learning_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with features and label, stored once: every step of learning reads it."""
    table = features(bars(spark, sf_dir), NAMES, HOUR)
    return stage(reversal_label(table, HOUR), "learning")


@query("imputed_scaled_features")
def _prepared(spark, sf_dir):
    table = reversal_label(features(bars(spark, sf_dir), ["sma_9", "roc_5"], HOUR), HOUR)
    rows = stage(ml.labelled_rows(table, ["sma_9", "roc_5"]), "rows")
    prepared = ml.Pipeline(stages=ml.preparation(rows.count(), 2)).fit(rows).transform(rows)
    x = ml.vector_to_array(ml.VECTOR)
    return shown(
        prepared.select("symbol", "time", x[0].alias("sma_9"), x[1].alias("roc_5")), ["sma_9", "roc_5"]
    )


@query("stratified_split")
def _split(spark, sf_dir):
    table = stratified_split(labelled(spark, sf_dir), "target", 0.3)
    return table.groupBy(F.col("target").cast("long").alias("target")).agg(
        F.count_if("is_test").alias("test_rows"), F.count(F.lit(1)).alias("all_rows")
    )


@query("ordered_split")
def _ordered(spark, sf_dir):
    table = ordered_split(labelled(spark, sf_dir), 0.3, HOUR)
    return table.groupBy("symbol").agg(
        F.count_if("is_test").alias("test_rows"),
        F.min(F.when(F.col("is_test"), F.unix_timestamp("time"))).alias("first_test"),
    )


def all_model_features(spark: SparkSession, sf_dir: str, adf: bool) -> DataFrame:
    return model_table(
        bars(spark, sf_dir).withColumn("spread", F.lit(0.025)),
        HOUR,
        latest_quotes(ticks(spark, sf_dir), 0.025),
        market_returns(bars(spark, sf_dir, market=MARKET), HOUR),
        adf,
    )


@query("model_features")
def _model_features(spark, sf_dir):
    return shown(all_model_features(spark, sf_dir, True), MODEL_FEATURES, PLAIN)


@query("model_features_in_sql")
def _model_features_in_sql(spark, sf_dir):
    """All model features but the rolling ADF, which plain SQL cannot fit."""
    names = [n for n in MODEL_FEATURES if n != "adf_stat_30"]
    return shown(all_model_features(spark, sf_dir, False), names, PLAIN)


def _first_model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ml.Trained]:
    split = stage(stratified_split(learning_table(spark, sf_dir), "target", 0.7), "split")
    return split, ml.fit(split, NAMES)


@query("forest_scores")
def _scores(spark, sf_dir):
    split, trained = _first_model(spark, sf_dir)
    scored = ml.score(trained.model, split, NAMES)
    return scored.groupBy("is_test", "target").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg((F.col("prediction_class") == F.col("target")).cast("double")).alias("accuracy"),
    )


@query("forest_importance")
def _importance(spark, sf_dir):
    _, trained = _first_model(spark, sf_dir)
    return ml.impurity_importance(trained, spark)


@query("whole_model")
def _whole_model(spark, sf_dir):
    """A forest on all model features, per symbol: its bars scored again by the reloaded model, and its newest bar.

    The accuracy is taken anew from the stored predictions; the gap to the one kept with the model is shown.
    """
    table = stage(all_model_features(spark, sf_dir, True), "model-features")
    split = stage(stratified_split(reversal_label(table, HOUR), "target", 0.7), "split")
    trained = ml.fit(split, ml.present(split, ml.available(split)))
    scored = stage(ml.score(trained.model, split, trained.names), "predictions")
    path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    ml.save(trained, path)
    again = ml.load(spark, path)
    newest = ml.latest_scores(again, table)
    anew = ml.score(again.model, split, again.names).select("symbol", "time", F.col("prediction_class").alias("again"))
    tested, hit = F.col("is_test"), (F.col("prediction_class") == F.col("target")).cast("double")
    known = F.col("predicted_class").isin(-1, 0, 1).alias("known")
    whole = scored.agg(F.avg(F.when(tested, hit)).alias("accuracy"), F.count_if(tested).alias("test_rows"))
    total = ml.impurity_importance(again, spark).agg(F.sum("importance").alias("total"))
    per_symbol = scored.join(anew, ["symbol", "time"]).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("scored_rows"), F.count_if(F.col("again") != F.col("prediction_class")).alias("changed_rows")
    )
    return per_symbol.join(newest, "symbol").select(
        "symbol", "scored_rows", "changed_rows", whole.select("test_rows").scalar().alias("test_rows"),
        rounded(whole.select("accuracy").scalar() - F.lit(again.accuracy)).alias("accuracy_gap"),
        rounded(total.scalar()).alias("importance_total"), F.unix_timestamp("time").alias("newest"),
        rounded("last_open").alias("last_open"), known,
    )


@query("permutation_importance")
def _permutation(spark, sf_dir):
    split, trained = _first_model(spark, sf_dir)
    return ml.permutation_importance(trained, split.where("is_test"))


@query("importance_threshold_sweep")
def _sweep(spark, sf_dir):
    split, trained = _first_model(spark, sf_dir)
    importance = stage(ml.permutation_importance(trained, split.where("is_test")), "importance")
    return ml.threshold_sweep(split, importance)


@query("hyper_parameter_search")
def _search(spark, sf_dir):
    split = stage(stratified_split(learning_table(spark, sf_dir), "target", 0.3), "split")
    _, table = ml.random_search(split, NAMES)
    return table


@query("latest_scores")
def _latest(spark, sf_dir):
    split, trained = _first_model(spark, sf_dir)
    return ml.latest_scores(trained, features(bars(spark, sf_dir), NAMES, HOUR))


@query("results_of_predictions")
def _predicted(spark, sf_dir):
    split, trained = _first_model(spark, sf_dir)
    scored = ml.score(trained.model, split, NAMES)
    hits = scored.where("is_test").groupBy("symbol").agg(
        F.avg((F.col("prediction_class") == F.col("target")).cast("double")).alias("accuracy")
    )
    signals = scored.select("symbol", "time", "close", F.col("prediction_class").alias("signal"))
    book = stage(ledger(signals, HOUR), "ledger")
    return reports.results_table(reports.summary(book), reports.closed_trades(book), hits)
