"""Grown forests as arrays: cutting them to fewer trees or less depth, and walking rows through them.

A forest of Spark ML is read from its saved nodes. Growth is level by level and draws the same
samples and features whatever the depth limit is, so a forest cut at a depth is the forest that a
fit with that limit grows: nodes at the limit become leaves, and pairs of leaves with the same
class are merged, as Spark merges them. Fewer trees are the first ones; a separate fit of fewer
trees draws others, so such a cut follows the law of the candidate, not its seed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

ROWS_AT_ONCE = 1000


@dataclass
class Forest:
    """Nodes of all trees, each tree in preorder; `left` and `right` are -1 at leaves."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    prediction: np.ndarray
    share: np.ndarray  # of each class among the training rows of a node
    depth: np.ndarray

    def stops(self, limit: int) -> np.ndarray:
        """Which nodes are leaves in the forest cut at depth `limit`."""
        leaf = (self.left < 0) | (self.depth >= limit)
        for level in range(min(limit, int(self.depth.max())) - 1, -1, -1):
            here = np.flatnonzero((self.depth == level) & ~leaf)
            a, b = self.left[here], self.right[here]
            leaf[here] = leaf[a] & leaf[b] & (self.prediction[a] == self.prediction[b])
        return leaf

    def step(self, node: np.ndarray, value: np.ndarray) -> np.ndarray:
        return np.where(value <= self.threshold[node], self.left[node], self.right[node])

    def walk(self, x: np.ndarray, at: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """The leaves that rows reach from the nodes `at` (rows x trees)."""
        at = at.copy()
        row, tree = np.nonzero(~leaf[at])
        while len(row):
            node = at[row, tree]
            node = self.step(node, x[row, self.feature[node]])
            at[row, tree] = node
            on = ~leaf[node]
            row, tree = row[on], tree[on]
        return at

    def starts(self, rows: int) -> np.ndarray:
        return np.repeat(self.roots[None, :], rows, 0)

    def classes(self, at: np.ndarray, trees: list[int] | None = None, votes: np.ndarray | None = None) -> list[np.ndarray]:
        """Predicted class of each row by the first n trees, for every n of `trees`; votes add up tree by tree.

        `votes` are those of earlier trees; the ones of all trees here are added in place.
        """
        wanted, out = trees or [at.shape[1]], {}
        votes = np.zeros((len(at), self.share.shape[1])) if votes is None else votes
        for t in range(at.shape[1]):
            votes += self.share[at[:, t]]
            if t + 1 in wanted:
                out[t + 1] = votes.argmax(1)
        return [out[n] for n in wanted]

    def tested(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves of the rows, and whether a feature is tested on the way: rows x trees x features."""
        leaf = self.left < 0
        at = self.starts(len(x))
        seen = np.zeros((*at.shape, x.shape[1]), bool)
        row, tree = np.nonzero(~leaf[at])
        while len(row):
            node = at[row, tree]
            seen[row, tree, self.feature[node]] = True
            node = self.step(node, x[row, self.feature[node]])
            at[row, tree] = node
            on = ~leaf[node]
            row, tree = row[on], tree[on]
        return at, seen


def forest_of(spark: SparkSession, model: RandomForestClassificationModel, path: str) -> Forest:
    """The nodes of a fitted forest, by way of its saved form at `path`."""
    model.write().overwrite().save(path)
    split = F.col("nodeData.split")
    table = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.leftChild", "nodeData.rightChild", "nodeData.prediction", "nodeData.impurityStats",
        split["featureIndex"].alias("feature"), F.coalesce(F.get(split["leftCategoriesOrThreshold"], 0), F.lit(0.0)).alias("threshold"),
    ).toArrow()
    order = np.lexsort((table["id"].to_numpy(), table["treeID"].to_numpy()))
    nodes = {c: table[c].to_numpy()[order] for c in table.column_names if c != "impurityStats"}
    roots = np.flatnonzero(nodes["id"] == 0)
    base = np.repeat(roots, np.diff(np.append(roots, len(order))))
    left, right = (np.where(nodes[c] < 0, -1, nodes[c] + base).astype(np.int32) for c in ("leftChild", "rightChild"))
    depth, level, at = np.zeros(len(order), np.int16), roots, 0
    while len(level):
        depth[level] = at
        inner = level[left[level] >= 0]
        level, at = np.concatenate([left[inner], right[inner]]), at + 1
    stats = table["impurityStats"].combine_chunks().flatten().to_numpy().reshape(len(order), -1)[order]
    total = stats.sum(1, keepdims=True)
    return Forest(
        roots.astype(np.int32), np.maximum(nodes["feature"], 0).astype(np.int16), nodes["threshold"],
        left, right, nodes["prediction"], np.divide(stats, total, out=np.zeros_like(stats), where=total > 0), depth,
    )
