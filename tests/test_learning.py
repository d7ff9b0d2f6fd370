import numpy as np
import pytest
from loops import walk
from pyspark.sql import functions as F

from barweave.operators.labels import reversal_label
from barweave.operators.split import ordered_split, stratified_split
from barweave.plans import ml
from barweave.plans.features import features
from barweave.session import shared_dir, stage

SECONDS = 300
NAMES = ["roc_5", "rsi_14", "sma_9", "change_percent"]


@pytest.fixture(scope="module")
def table(spark):
    bars = spark.createDataFrame(walk("A", 900, 31))
    labelled = reversal_label(features(bars, NAMES, SECONDS), SECONDS).withColumn("constant", F.lit(1.0))
    return stage(labelled.withColumn("absent", F.lit(None).cast("double")), "learning-test")


@pytest.fixture(scope="module")
def trained(table):
    split = stratified_split(table, "target", 0.3)
    return split, ml.fit(split, [*NAMES, "constant"], trees=8, depth=6)


def test_features_without_values_are_left_out(table):
    assert ml.present(table, [*NAMES, "absent"]) == NAMES
    assert ml.available(table, ["roc_5", "+DM"]) == ["roc_5"]


def test_scores_and_reload(spark, trained):
    split, model = trained
    path = f"{shared_dir(spark)}/model-test"
    ml.save(model, path)
    again = ml.load(spark, path)
    assert again.names == model.names and again.accuracy == pytest.approx(model.accuracy)
    a = ml.score(model.model, split, model.names).orderBy("time").toPandas()
    b = ml.score(again.model, split, again.names).orderBy("time").toPandas()
    assert (a.prediction_class == b.prediction_class).all()
    assert set(a.prediction_class) <= {-1, 0, 1}
    test = a[a.is_test]
    assert (test.prediction_class == test.target).mean() == pytest.approx(model.accuracy)


def test_importances(spark, trained):
    split, model = trained
    impurity = ml.impurity_importance(model, spark).toPandas()
    assert impurity.importance.sum() == pytest.approx(1.0)
    assert impurity.importance.is_monotonic_decreasing
    permuted = ml.permutation_importance(model, split.where("is_test"), repeats=3).toPandas()
    values = permuted.set_index("feature").importance
    assert values["constant"] == 0 and set(values.index) == set(model.names)


def test_permutation_uses_every_row_once(spark, trained):
    from barweave.operators.split import place_by_hash, row_hash

    split, _ = trained
    rows = split.select("symbol", "time").withColumn("_h", row_hash(["symbol", "time"], 5)).withColumn("g", F.lit(0))
    places = sorted(r.p for r in place_by_hash(rows, "_h", ["g"], "p").select("p").collect())
    assert places == list(range(split.count()))


def test_sweep_and_selection(spark, trained):
    split, _ = trained
    importance = spark.createDataFrame(
        [("roc_5", 0.01), ("rsi_14", 0.001), ("sma_9", -0.0001)], "feature string, importance double"
    )
    assert ml.select_features(importance) == ["roc_5", "rsi_14"]
    sweep = ml.threshold_sweep(split, importance, [-0.0005, 0.0, 0.0005, 0.5], trees=3, depth=3).toPandas()
    assert list(sweep.n_features) == [3, 2, 2, 0]
    assert sweep.accuracy[1] == sweep.accuracy[2] and np.isnan(sweep.accuracy[3])


def test_grid():
    grid = ml.sampled_grid()
    assert len(grid) == 48 and all(c["maxDepth"] in (10, 15, 20, 30) for c in grid)
    assert len({str(c) for c in grid}) == len(grid)


@pytest.fixture(scope="module")
def grown(trained):
    """Prepared rows and a function that fits a forest on them."""
    split, model = trained
    prepared = ml.PipelineModel(stages=model.model.stages[:-1]).transform(ml.labelled_rows(split, model.names)).persist()
    yield prepared, lambda trees, depth, **more: ml.forest(trees, depth).setParams(**more).fit(prepared)
    prepared.unpersist()


def test_cut_forests_equal_separate_fits(spark, grown, tmp_path):
    prepared, fit = grown
    for more in ({}, {"minInstancesPerNode": 2, "featureSubsetStrategy": "log2"}):
        deep = fit(12, 14, **more)
        trees = ml.forest_of(spark, deep, f"file://{tmp_path}/{len(more)}")
        rows = prepared.select(ml.LABEL, ml.vector_to_array(ml.VECTOR).alias("x")).toPandas()
        x, at = np.stack(rows["x"]), trees.starts(len(rows))
        for depth in (1, 3, 6, 14):
            at = trees.walk(x, at, trees.stops(depth))
            mine = trees.classes(at)[0]
            theirs = fit(12, depth, **more).transform(prepared).toPandas()["prediction"]
            assert (mine == theirs).all()
        votes = sum(np.array([t.predictProbability(ml.Vectors.dense(v)).toArray() for v in x[:50]]) for t in deep.trees[:5])
        assert (trees.classes(at, [5])[0][:50] == votes.argmax(1)).all()


def test_search_equals_counting_cut_by_cut(spark, trained):
    split, model = trained
    candidates = [{"numTrees": n, "maxDepth": d, "minInstancesPerNode": m} for n in (2, 5) for d in (2, 5) for m in (1, 2)]
    best, table = ml.random_search(split, model.names, candidates)
    got = {r.parameters: r.accuracy for r in table.collect()}
    assert len(got) == 8 and best.forest.getNumTrees == [c for c in candidates if got[str(c)] == max(got.values())][0]["numTrees"]
    train = ml.labelled_rows(split, model.names).where("not is_test")
    prepared = ml.Pipeline(stages=ml.preparation(train.count(), len(model.names))).fit(train).transform(train)
    folded = prepared.withColumn("fold", F.pmod(ml.row_hash(["symbol", "time"], ml.SEED), F.lit(3))).persist()
    for c in candidates:
        if c["numTrees"] == 5:  # the most trees, so the very forest of a separate fit
            rates = []
            for k in range(3):
                estimator = ml.forest(5, c["maxDepth"]).setMinInstancesPerNode(c["minInstancesPerNode"])
                rates.append(ml.accuracy(estimator.fit(folded.where(F.col("fold") != k)).transform(folded.where(F.col("fold") == k))))
            assert got[str(c)] == pytest.approx(sum(rates) / 3, abs=1e-12)
    folded.unpersist()


def test_search_grows_large_forests_in_batches(spark, trained, monkeypatch):
    split, model = trained
    train = ml.labelled_rows(split, model.names).where("not is_test")
    prepared = ml.Pipeline(stages=ml.preparation(train.count(), len(model.names))).fit(train).transform(train)
    folded = prepared.withColumn("fold", F.pmod(ml.row_hash(["symbol", "time"], ml.SEED), F.lit(3))).persist()
    read, sizes = ml.forest_of, []
    monkeypatch.setattr(ml, "forest_of", lambda spark, grown, path: sizes.append(grown.getNumTrees) or read(spark, grown, path))
    monkeypatch.setattr(ml, "ROWS_GROWN", 3 * 3 * folded.where("fold != 0").count(), raising=False)
    candidates = [{"numTrees": n, "maxDepth": d} for n in (2, 4, 7) for d in (3, 6)]
    _, table = ml.random_search(split, model.names, candidates)
    assert sum(sizes) == 3 * 7 and max(sizes) <= 4  # the folds' sizes differ a little
    got = {r.parameters: r.accuracy for r in table.collect()}
    rates = {str(c): 0.0 for c in candidates}
    for k in range(3):
        others, held = folded.where(F.col("fold") != k), folded.where(F.col("fold") == k).toPandas()
        for d in (3, 6):
            batches = ml.tree_batches(7, others.count(), 3)
            trees = [t for b, n in enumerate(batches) for t in ml.forest(n, d, ml.SEED + (b << 32)).fit(others).trees]
            shares = [[t.predictProbability(v).toArray() for t in trees] for v in held[ml.VECTOR]]
            for n in (2, 4, 7):
                hits = [sum(row[:n]).argmax() == label for row, label in zip(shares, held[ml.LABEL])]
                rates[str({"numTrees": n, "maxDepth": d})] += np.mean(hits) / 3
    assert got == pytest.approx(rates, abs=1e-12)
    folded.unpersist()


def test_rescored_paths_equal_whole_rescoring(spark, trained, grown, tmp_path):
    import pandas as pd

    _, model = trained
    prepared, _ = grown
    rows = prepared.select(ml.LABEL, ml.vector_to_array(ml.VECTOR).alias("x")).toPandas()
    rows["repeat"], rows["donor"] = np.arange(len(rows)) % 3, list(np.stack(rows["x"])[::-1])
    trees = ml.forest_of(spark, model.forest, f"file://{tmp_path}/forest")
    got = pd.concat(ml.swapped_hits(trees, iter([rows]))).groupby(["j", "repeat"]).hits.sum()
    for j in range(len(model.names) + 1):
        x = np.stack(rows["x"]).copy()
        if j < x.shape[1]:
            x[:, j] = np.stack(rows["donor"])[:, j]
        plain = spark.createDataFrame([(i, ml.Vectors.dense(v)) for i, v in enumerate(x)], ["i", ml.VECTOR])
        classes = model.forest.transform(plain).orderBy("i").toPandas()["prediction"]
        for r in range(3):
            mine = rows["repeat"] == r
            assert got[j, r] == (classes[mine] == rows[ml.LABEL][mine]).sum()


def test_training_end_to_end(spark, table):
    best, reports = ml.train(
        table, NAMES, trees=3, depth=3, repeats=1, candidates=[{"numTrees": 3, "maxDepth": 3}, {"numTrees": 3, "maxDepth": 2}]
    )
    assert 0 <= best.accuracy <= 1 and set(best.names) <= set(NAMES)
    assert reports["search"].count() == 2 and reports["sweep"].count() == 5
    latest = ml.latest_scores(best, table).collect()
    assert len(latest) == 1 and latest[0].predicted_class in (-1, 0, 1)
    assert latest[0].time == table.agg(F.max("time")).first()[0]


def test_newest_rows_are_the_test_part(table):
    split = ordered_split(table, 0.25, SECONDS)
    edge = split.groupBy("is_test").agg(F.min("time").alias("a"), F.max("time").alias("b"), F.count("*").alias("n"))
    parts = {r.is_test: r for r in edge.collect()}
    assert parts[False].b < parts[True].a
    assert parts[True].n == round(0.25 * table.count())


def test_queries_run_the_operators_with_their_defaults(monkeypatch):
    from inspect import signature
    from types import SimpleNamespace
    from unittest.mock import MagicMock

    from barweave.catalog import learning

    used = {}
    for name in ("fit", "permutation_importance", "threshold_sweep", "random_search"):
        real = signature(getattr(ml, name))

        def record(*args, name=name, real=real, **kwargs):
            bound = real.bind(*args, **kwargs)
            bound.apply_defaults()
            used[name] = bound.arguments
            return MagicMock(), MagicMock()

        monkeypatch.setattr(ml, name, record)
    for name in ("stage", "stratified_split", "learning_table"):
        monkeypatch.setattr(learning, name, lambda *args: SimpleNamespace(where=lambda _: None))
    learning._permutation(None, "")
    learning._sweep(None, "")
    learning._search(None, "")
    assert (used["fit"]["trees"], used["fit"]["depth"]) == (100, 30)
    assert used["permutation_importance"]["repeats"] == 10
    assert (used["threshold_sweep"]["trees"], used["threshold_sweep"]["depth"]) == (100, 30)
    assert used["random_search"]["candidates"] is None and len(ml.sampled_grid()) == 48
