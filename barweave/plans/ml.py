"""Learning the label: preparation, forests, importances, selection, search and scores."""

from __future__ import annotations

import math
import random
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool
from threading import Lock

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import ElementwiseProduct, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave import schema as S
from barweave.operators.split import place_by_hash, row_hash, stratified_split
from barweave.plans.trees import ROWS_AT_ONCE, Forest, forest_of
from barweave.session import shared_dir

LABEL = "label"
VECTOR = "features"
MAX_DEPTH = 30  # the deepest tree Spark grows
SEED = 42
TREES = 100
# Rows times trees that the fits running at once in a search may grow. Spark keeps growing trees on the driver, whose
# memory this bounds (0.4 nodes per row and tree on the hourly bars, at most 1.3). One tree per fit is the least.
ROWS_GROWN = 250_000

# The search grid. The smallest node to split has no Spark parameter, so its
# values only repeat a combination. None means no depth limit.
GRID = {
    "numTrees": [100, 200, 300],
    "maxDepth": [None, 10, 15, 20],
    "min_samples_split": [2, 5, 10],
    "minInstancesPerNode": [1, 2],
    "featureSubsetStrategy": ["sqrt", "log2"],
    "bootstrap": [True],
}


def available(df: DataFrame, names: list[str] = S.MODEL_FEATURES) -> list[str]:
    """The wanted features this table has."""
    return [n for n in names if n in df.columns]


def labelled_rows(df: DataFrame, names: list[str]) -> DataFrame:
    """Keys, features as doubles and a class label from 0 (Spark ML has no negative labels)."""
    keys = [c for c in ("symbol", "time", "open", "close", "target", "is_test") if c in df.columns]
    features = [F.col(f"`{n}`").cast("double").alias(f"x_{i}") for i, n in enumerate(names)]
    return df.select(*keys, *features, (F.col("target") + 1).cast("double").alias(LABEL))


def present(df: DataFrame, names: list[str]) -> list[str]:
    """Features with at least one value; a mean cannot replace a column that has none."""
    counts = df.agg(*[F.count(F.col(f"`{n}`")).alias(f"n_{i}") for i, n in enumerate(names)]).first()
    return [n for i, n in enumerate(names) if counts[f"n_{i}"]]


def preparation(count: int, width: int) -> list:
    """Mean imputation, one vector, and scaling by the deviation of the population."""
    inputs = [f"x_{i}" for i in range(width)]
    filled = [f"f_{i}" for i in range(width)]
    population = (count / (count - 1)) ** 0.5
    return [
        Imputer(strategy="mean", inputCols=inputs, outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="raw", handleInvalid="keep"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True),
        ElementwiseProduct(
            scalingVec=Vectors.dense([population] * width), inputCol="scaled", outputCol=VECTOR
        ),
    ]


def forest(trees: int = TREES, depth: int = MAX_DEPTH, seed: int = SEED) -> RandomForestClassifier:
    # With cached node ids the growing trees are not sent to the executors for every level.
    return RandomForestClassifier(
        labelCol=LABEL, featuresCol=VECTOR, numTrees=trees, maxDepth=depth, seed=seed, cacheNodeIds=True, maxMemoryInMB=512
    )


@dataclass
class Trained:
    """A fitted pipeline, the features it reads, and its accuracy on the test part."""

    model: PipelineModel
    names: list[str]
    accuracy: float

    @property
    def forest(self) -> RandomForestClassificationModel:
        return self.model.stages[-1]


def accuracy(predictions: DataFrame) -> float:
    metric = MulticlassClassificationEvaluator(labelCol=LABEL, metricName="accuracy")
    return metric.evaluate(predictions)


def score(model: PipelineModel, df: DataFrame, names: list[str]) -> DataFrame:
    """Every row with its predicted class `prediction_class` in -1, 0, 1."""
    rows = df if "target" in df.columns else df.withColumn("target", F.lit(0))
    scored = model.transform(labelled_rows(rows, names))
    keep = [c for c in ("symbol", "time", "open", "close", "target", "is_test") if c in df.columns]
    return scored.select(*keep, (F.col("prediction") - 1).cast("int").alias("prediction_class"))


def fit(
    split: DataFrame, names: list[str], trees: int = TREES, depth: int = MAX_DEPTH, fit_on_all: bool = False
) -> Trained:
    """Fit on the rows with is_test false; `fit_on_all` fits imputer and scaler on all rows."""
    rows = labelled_rows(split, names).persist()
    train = rows.where(~F.col("is_test"))
    basis = rows if fit_on_all else train
    steps = Pipeline(stages=preparation(basis.count(), len(names))).fit(basis)
    grown = forest(trees, depth).fit(steps.transform(train))
    model = PipelineModel(stages=[*steps.stages, grown])
    result = Trained(model, names, accuracy(model.transform(rows.where("is_test"))))
    rows.unpersist()
    return result


def impurity_importance(trained: Trained, spark: SparkSession) -> DataFrame:
    """(feature, importance), most important first."""
    weights = trained.forest.featureImportances.toArray()
    rows = [(n, float(w)) for n, w in zip(trained.names, weights)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


def swapped_hits(trees: Forest, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hits per feature j and repeat when the row takes that value of its donor; j = number of features swaps nothing."""
    leaf = trees.left < 0
    for batch in batches:
        for first in range(0, len(batch), ROWS_AT_ONCE):
            part = batch.iloc[first : first + ROWS_AT_ONCE]
            x, donor, label = np.stack(part["x"]), np.stack(part["donor"]), part[LABEL].to_numpy()
            at, seen = trees.tested(x)
            width = x.shape[1]
            hits = {width: trees.classes(at)[0] == label}
            for j in range(width):
                moved, (row, tree) = at, np.nonzero(seen[:, :, j] & (x[:, j] != donor[:, j])[:, None])
                if len(row):
                    other = x.copy()
                    other[:, j] = donor[:, j]
                    moved = at.copy()
                    moved[row, tree] = trees.roots[tree]
                    moved = trees.walk(other, moved, leaf)
                hits[j] = trees.classes(moved)[0] == label
            found = pd.DataFrame(hits).groupby(part["repeat"].to_numpy()).agg("sum")
            sizes = part.groupby("repeat").size()
            yield pd.DataFrame([(j, r, int(found.at[r, j]), int(sizes[r])) for r in found.index for j in found.columns], columns=["j", "repeat", "hits", "n"])


def permutation_importance(
    trained: Trained, test: DataFrame, repeats: int = 10, seed: int = SEED
) -> DataFrame:
    """(feature, importance, deviation): loss of accuracy when one feature is permuted.

    Per repeat every row meets one other row, its donor: the row at its position in another
    hash order. One join brings the donor's whole vector, and each feature swaps one value. Only
    the trees that test the swapped feature on the row's path are walked again.
    """
    spark = test.sparkSession
    prepared = PipelineModel(stages=trained.model.stages[:-1]).transform(labelled_rows(test, trained.names))
    base = prepared.select("symbol", "time", LABEL, vector_to_array(VECTOR).alias("x"))
    keys = ["symbol", "time"]
    donors = place_by_hash(
        base.select(*keys, "x", F.lit(0).alias("_g"), row_hash(keys, seed).alias("_h")), "_h", ["_g"], "_place"
    ).select("_place", F.col("x").alias("donor"))
    repeated = base.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    repeated = repeated.withColumn("_h", row_hash(keys, F.col("repeat") + seed))
    met = place_by_hash(repeated, "_h", ["repeat"], "_place").join(donors, "_place").select(LABEL, "repeat", "x", "donor")
    width = len(trained.names)
    trees = forest_of(spark, trained.forest, f"{shared_dir(spark)}/forest-{uuid.uuid4().hex}")
    rates = (
        met.mapInPandas(lambda batches: swapped_hits(trees, batches), "j int, repeat int, hits long, n long")
        .groupBy("j", "repeat")
        .agg((F.sum("hits") / F.sum("n")).alias("rate"))
    )
    plain = rates.where(F.col("j") == width).select("repeat", F.col("rate").alias("base"))
    losses = rates.where(F.col("j") < width).join(plain, "repeat")
    names = spark.createDataFrame(list(enumerate(trained.names)), "j int, feature string")
    return (
        losses.groupBy("j")
        .agg(
            F.avg(F.col("base") - F.col("rate")).alias("importance"),
            F.stddev_pop(F.col("base") - F.col("rate")).alias("deviation"),
        )
        .join(names, "j")
        .select("feature", "importance", "deviation")
        .orderBy(F.desc("importance"), "feature")
    )


def select_features(importance: DataFrame, limit: float = S.IMPORTANCE_LIMIT) -> list[str]:
    """Names above the limit; at most one per model feature."""
    chosen = importance.where(F.col("importance") > limit).orderBy(F.desc("importance"), "feature")
    return [r["feature"] for r in chosen.select("feature").collect()]


def threshold_sweep(
    split: DataFrame,
    importance: DataFrame,
    thresholds: list[float] = S.IMPORTANCE_SWEEP,
    trees: int = TREES,
    depth: int = MAX_DEPTH,
) -> DataFrame:
    """(threshold, n_features, accuracy): a forest per distinct selection."""
    values = {r["feature"]: r["importance"] for r in importance.collect()}
    seen: dict[tuple[str, ...], float] = {}
    rows = []
    for threshold in thresholds:
        chosen = tuple(n for n, v in values.items() if v > threshold)
        if chosen and chosen not in seen:
            seen[chosen] = fit(split, list(chosen), trees, depth).accuracy
        rows.append((threshold, len(chosen), seen.get(chosen)))
    return split.sparkSession.createDataFrame(rows, "threshold double, n_features int, accuracy double")


def sampled_grid(grid: dict = GRID, size: int = 50, seed: int = SEED) -> list[dict]:
    """`size` different random combinations of the grid, as Spark parameters; all if there are no more."""
    combinations = [{}]
    for name, values in grid.items():
        if name != "min_samples_split":
            values = [MAX_DEPTH if name == "maxDepth" and v is None else v for v in values]
            combinations = [{**c, name: v} for c in combinations for v in values]
    return random.Random(seed).sample(combinations, min(size, len(combinations)))


def tree_batches(trees: int, rows: int, fits: int) -> list[int]:
    """Trees of each batch of a forest on so many rows, when `fits` of them grow at once."""
    count = math.ceil(trees / max(1, ROWS_GROWN // max(1, rows * fits)))
    return [trees // count + (i < trees % count) for i in range(count)]


def cut_votes(trees: Forest, cuts: list[tuple[int, int]], before: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds a batch of trees, `before` others came first, to the votes of every row at each depth of the cuts.

    A cut (trees, depth) that has all its trees now gets its place in `hits`: 1 where its class is the label.
    """
    depths = sorted({d for _, d in cuts})
    stops = {d: trees.stops(d) for d in depths}
    for batch in batches:
        for first in range(0, len(batch), ROWS_AT_ONCE):
            part = batch.iloc[first : first + ROWS_AT_ONCE]
            x, label, hits = np.stack(part["x"]), part[LABEL].to_numpy(), np.stack(part["hits"])
            votes = np.zeros((len(depths), len(x), trees.share.shape[1]))
            if before:
                votes += np.stack(part["votes"]).reshape(len(x), len(depths), -1).swapaxes(0, 1)
            at = trees.starts(len(x))
            for d, sums in zip(depths, votes):  # a deeper cut goes on where the one before stopped
                at = trees.walk(x, at, stops[d])
                asked = [(i, n - before) for i, (n, depth) in enumerate(cuts) if depth == d and 0 < n - before <= at.shape[1]]
                sizes = sorted({n for _, n in asked})
                right = dict(zip(sizes, (c == label for c in trees.classes(at, sizes, sums))))
                for i, n in asked:
                    hits[:, i] = right[n]
            yield part.assign(votes=list(votes.swapaxes(0, 1).reshape(len(x), -1)), hits=list(hits))


def random_search(
    split: DataFrame,
    names: list[str],
    candidates: list[dict] | None = None,
    folds: int = 3,
    parallelism: int = 8,
) -> tuple[Trained, DataFrame]:
    """The best forest by cross-validated accuracy, and the table of all candidates.

    Candidates that differ in trees and depth alone are cuts of one forest: it is grown once per
    fold with the most trees and the largest depth among them, so the whole grid takes 12 forests
    instead of 144. A cut to fewer trees has the law of its candidate, not its seed. A forest too
    large for the driver grows in batches of trees, each with a seed of its own, and the held rows
    take their votes from batch to batch through a stored table. Folds follow a hash of symbol and
    time, so they are the same on every run. The winner is fitted anew on all training rows, whole,
    as it is returned; of equal candidates the first one wins.
    """
    candidates = sampled_grid() if candidates is None else candidates
    spark = split.sparkSession
    rows = labelled_rows(split, names).persist()
    train = rows.where(~F.col("is_test"))
    steps = Pipeline(stages=preparation(train.count(), len(names))).fit(train)
    fold = F.pmod(row_hash(["symbol", "time"], SEED), F.lit(folds)).alias("fold")
    prepared = steps.transform(train).select(LABEL, VECTOR, fold).persist()
    sizes = {r["fold"]: r["count"] for r in prepared.groupBy("fold").count().collect()}
    shapes: dict[tuple, list[int]] = {}
    for i, c in enumerate(candidates):
        shapes.setdefault(tuple(sorted((k, v) for k, v in c.items() if k not in ("numTrees", "maxDepth"))), []).append(i)
    jobs = [(shape, number) for shape in shapes for number in range(folds)]
    largest = max(c.get("numTrees", TREES) for c in candidates) * sum(sorted(sizes.values())[1:])
    reading = Lock()  # saving a forest takes as much of the driver's memory as growing it
    at_once = min(parallelism, len(jobs), max(3, ROWS_GROWN // max(1, largest)))

    def voted(rows: DataFrame, job: tuple[tuple, int], cuts: list[tuple[int, int]], before: int, trees: int, batch: int, path: str) -> DataFrame:
        estimator = forest(trees, max(d for _, d in cuts), SEED + (batch << 32))
        grown = estimator.fit(prepared.where(F.col("fold") != job[1]), {estimator.getParam(k): v for k, v in job[0]})
        with reading:
            read = forest_of(spark, grown, f"{path}/forest")
        return rows.mapInPandas(lambda batches: cut_votes(read, cuts, before, batches), rows.schema)

    def rates(job: tuple[tuple, int]) -> list[tuple[int, float]]:
        shape, number = job
        cuts = [(candidates[i].get("numTrees", TREES), candidates[i].get("maxDepth", MAX_DEPTH)) for i in shapes[shape]]
        held = prepared.where(F.col("fold") == number).select(
            LABEL, vector_to_array(VECTOR).alias("x"), F.array().cast("array<double>").alias("votes"), F.array_repeat(F.lit(0), len(cuts)).alias("hits")
        )
        path, before, most = f"{shared_dir(spark)}/search-{uuid.uuid4().hex}", 0, max(n for n, _ in cuts)
        others = sum(n for fold, n in sizes.items() if fold != number)
        for batch, trees in enumerate(tree_batches(most, others, at_once)):
            if batch:  # two tables take turns
                held.write.mode("overwrite").parquet(f"{path}/votes-{batch % 2}")
                held = spark.read.schema(held.schema).parquet(f"{path}/votes-{batch % 2}")
            held = voted(held, job, cuts, before, trees, batch, path)
            before += trees
        found = held.agg(*[F.avg(F.get("hits", i)).alias(f"rate_{i}") for i in range(len(cuts))]).first()
        return list(zip(shapes[shape], found))

    sums = [0.0] * len(candidates)
    with ThreadPool(at_once) as pool:
        for found in pool.imap(inheritable_thread_target(spark)(rates), jobs):
            for i, rate in found:
                sums[i] += rate / folds
    best = candidates[max(range(len(candidates)), key=lambda i: sums[i])]
    estimator = forest()
    chosen = estimator.fit(steps.transform(train), {estimator.getParam(k): v for k, v in best.items()})
    model = PipelineModel(stages=[*steps.stages, chosen])
    trained = Trained(model, names, accuracy(model.transform(rows.where("is_test"))))
    prepared.unpersist()
    rows.unpersist()
    table = spark.createDataFrame([(str(c), float(m)) for c, m in zip(candidates, sums)], "parameters string, accuracy double")
    return trained, table


def save(trained: Trained, path: str) -> None:
    """The whole pipeline (imputer, scaler, forest) and the table of selected features."""
    trained.model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    rows = [(i, n, trained.accuracy) for i, n in enumerate(trained.names)]
    table = spark.createDataFrame(rows, "position int, feature string, accuracy double")
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/selected_features")


def load(spark: SparkSession, path: str) -> Trained:
    rows = spark.read.parquet(f"{path}/selected_features").orderBy("position").collect()
    return Trained(
        PipelineModel.load(f"{path}/model"), [r["feature"] for r in rows], rows[0]["accuracy"]
    )


def latest_scores(trained: Trained, table: DataFrame) -> DataFrame:
    """(symbol, time, last_open, predicted_class) of the newest row of every symbol."""
    columns = [f"`{c}`" for c in dict.fromkeys(["open", "close", *trained.names])]
    newest = table.groupBy("symbol").agg(
        F.max("time").alias("time"), F.max_by(F.struct(*columns), "time").alias("_row")
    )
    rows = newest.select("symbol", "time", "_row.*")
    return score(trained.model, rows, trained.names).select(
        "symbol", "time", F.col("open").alias("last_open"), F.col("prediction_class").alias("predicted_class")
    )


def train(
    labelled: DataFrame,
    names: list[str] | None = None,
    first_test_fraction: float = 0.7,
    test_fraction: float = 0.3,
    limit: float = S.IMPORTANCE_LIMIT,
    trees: int = TREES,
    depth: int = MAX_DEPTH,
    repeats: int = 10,
    candidates: list[dict] | None = None,
) -> tuple[Trained, dict[str, DataFrame]]:
    """First forest, importances, threshold sweep, selection, and the search on what is left.

    `labelled` is read by every step: pass a stored table, of one symbol or of many.
    """
    names = present(labelled, available(labelled, names or S.MODEL_FEATURES))
    first_split = stratified_split(labelled, "target", first_test_fraction)
    first = fit(first_split, names, trees, depth)
    spark = labelled.sparkSession
    impurity = impurity_importance(first, spark)
    permuted = permutation_importance(first, first_split.where("is_test"), repeats).persist()
    split = stratified_split(labelled, "target", test_fraction)
    sweep = threshold_sweep(split, permuted, trees=trees, depth=depth)
    chosen = select_features(permuted, limit) or names
    best, table = random_search(split, chosen, candidates)
    permuted.unpersist()
    return best, {"impurity": impurity, "permutation": permuted, "sweep": sweep, "search": table}

