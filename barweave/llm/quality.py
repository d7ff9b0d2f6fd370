"""Quality scores from random-indexing word vectors and a small two-layer network.

Every token has a fixed sparse random index vector. The context vector of a token is the sum of
the index vectors of its neighbours over the whole corpus, so one counting pass gives all word
vectors. Tokens share a fixed number of buckets, which bounds the table whatever the vocabulary.
A document is the pooled vectors of its tokens; a two-layer network in numpy, with its temperature
fitted on held-back rows, turns that into a probability.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
WIDTH = 32
NONZERO = 4
HIDDEN = 32
# The network is fitted on so many labelled rows at most, chosen by a hash of their key.
MAX_TRAINING_ROWS = 20_000
SEED = 17
TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\x00-\x20A-Za-z0-9\x80-\xff]+")


def bucket_ids(text: str | None) -> np.ndarray:
    """Buckets of the tokens of a text: runs of letters, of digits, of other marks; case is kept."""
    if not isinstance(text, str):
        return np.empty(0, np.int64)
    tokens = TOKEN.findall(text.encode("utf-8", "surrogatepass"))
    return np.fromiter(map(crc32, tokens), np.int64, len(tokens)) & (BUCKETS - 1)


def index_vectors() -> np.ndarray:
    """Random index vectors: NONZERO entries of +1 or -1 each; a last row of zeros stands for no token."""
    rng = np.random.default_rng(SEED)
    table = np.zeros((BUCKETS + 1, WIDTH), np.int32)
    places = np.argsort(rng.random((BUCKETS, WIDTH)), axis=1)[:, :NONZERO]
    np.put_along_axis(table[:-1], places, rng.choice([-1, 1], (BUCKETS, NONZERO)), axis=1)
    return table


def context_sums(docs: DataFrame, text: str) -> DataFrame:
    """Per bucket: n (tokens) and v0.. (summed index vectors of the neighbours), over all rows."""
    names = [f"v{i}" for i in range(WIDTH)]

    def count(batches):
        index = index_vectors()
        sums, n = np.zeros((BUCKETS, WIDTH), np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            gap = np.array([BUCKETS])
            ids = np.concatenate([gap, *[a for t in batch["text"] for a in (bucket_ids(t), gap)]])
            for start in range(1, len(ids) - 1, 1 << 18):  # bounded memory for long texts
                own = ids[start : min(start + (1 << 18), len(ids) - 1)]
                stop = start + len(own)
                order = np.argsort(own, kind="stable")
                around = (index[ids[start - 1 : stop - 1]] + index[ids[start + 1 : stop + 1]])[order]
                there, first, many = np.unique(own[order], return_index=True, return_counts=True)
                real = there < BUCKETS
                sums[there[real]] += np.add.reduceat(around, first, axis=0, dtype=np.int64)[real]
                n[there[real]] += many[real]
        used = np.flatnonzero(n)
        yield pd.DataFrame(sums[used], columns=names).assign(bucket=used, n=n[used])

    schema = ", ".join(["bucket long", "n long", *[f"{c} long" for c in names]])
    parts = docs.select(F.col(text).alias("text")).mapInPandas(count, schema)
    return parts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ["n", *names]])


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Mean context of each bucket, less the mean of all contexts. BUCKETS rows, whatever the corpus."""
    table = context_sums(docs, text).toPandas()
    vectors = np.zeros((BUCKETS, WIDTH))
    if len(table):
        sums, n = table[[f"v{i}" for i in range(WIDTH)]].to_numpy(float), table["n"].to_numpy(float)
        vectors[table["bucket"]] = sums / n[:, None] - sums.sum(axis=0) / n.sum()
    return vectors.astype(np.float32)


def pooled(text: str | None, vectors: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Mean and deviation of the context vectors, mean of the index vectors, and the length."""
    ids = bucket_ids(text)
    out = np.zeros(3 * WIDTH + 1, np.float32)
    if len(ids):
        there, many = np.unique(ids, return_counts=True)
        share = (many / len(ids)).astype(np.float32)
        v = vectors[there]
        mean = share @ v
        out[:WIDTH] = mean
        out[WIDTH : 2 * WIDTH] = np.sqrt(np.maximum(share @ (v * v) - mean * mean, 0))
        out[2 * WIDTH : -1] = share @ index[there].astype(np.float32)
        out[-1] = np.log1p(len(ids)) / 10
    return out


@dataclass(frozen=True)
class Network:
    """tanh layer, then a probability at a temperature; `centre` and `scale` standardise the input."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def fit_network(x: np.ndarray, y: np.ndarray, rounds: int = 30, step: float = 0.01) -> Network:
    """Adam on the log loss of four fifths of the rows; the temperature is fitted on the last fifth.

    Without rows of both classes the score is the share of label 1 (one half without any row).
    """
    rng = np.random.default_rng(SEED)
    width = x.shape[1]
    if len(np.unique(y)) < 2:
        p = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), np.log(p / (1 - p)))
    order = rng.permutation(len(y))
    held, own = order[: len(y) // 5], order[len(y) // 5 :]
    centre, scale = x[own].mean(axis=0), x[own].std(axis=0) + 1e-6
    z = (x - centre) / scale
    state = [rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second, t = [np.zeros_like(s) for s in state], [np.zeros_like(s) for s in state], 0
    for _ in range(rounds):
        rng.shuffle(own)
        for start in range(0, len(own), 128):
            rows = own[start : start + 128]
            h = np.tanh(z[rows] @ state[0] + state[1])
            error = (1 / (1 + np.exp(-np.clip(h @ state[2] + state[3], -60, 60))) - y[rows]) / len(rows)
            back = np.outer(error, state[2]) * (1 - h * h)
            slopes = [z[rows].T @ back + 1e-4 * state[0], back.sum(axis=0), h.T @ error, np.array([error.sum()])]
            t += 1
            for i, g in enumerate(slopes):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                state[i] = state[i] - step * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    net = Network(centre, scale, state[0], state[1], state[2], float(state[3][0]))
    if len(held) == 0:
        return net
    logits, target = net.logits(x[held]), y[held]
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    loss = [np.logaddexp(0, np.where(target > 0, -1, 1) * logits / g).mean() for g in grid]
    return Network(net.centre, net.scale, net.w1, net.b1, net.w2, net.b2, float(grid[int(np.argmin(loss))]))


@dataclass(frozen=True)
class QualityModel:
    vectors: np.ndarray
    network: Network


def fit_quality(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    max_rows: int = MAX_TRAINING_ROWS,
) -> QualityModel:
    """Word vectors from all of `docs`, the network from at most `max_rows` of `labels`.

    The word vectors use every row. Labelled rows are taken by the order of a hash of their key;
    rows with a null key or label are left out, several labels of a key count by their mean.
    """
    vectors = word_vectors(docs, text)
    chosen = (
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(key).alias("_key")).agg((F.avg(label) >= 0.5).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_key"), "_key").limit(max_rows)
    )
    # At most max_rows keys, so this side may be broadcast.
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(F.broadcast(chosen), "_key")

    def features(batches):
        index = index_vectors()
        for batch in batches:
            yield pd.DataFrame(
                {"k": batch["_key"].astype(str), "y": batch["_label"], "x": [pooled(t, vectors, index).tolist() for t in batch["text"]]}
            )

    table = rows.mapInPandas(features, "k string, y int, x array<float>").orderBy("k").toPandas()
    x = np.array(table["x"].tolist(), np.float64).reshape(-1, 3 * WIDTH + 1)
    return QualityModel(vectors, fit_network(x, table["y"].to_numpy(float)))


def score_udf(model: QualityModel):
    """A column function text -> probability of label 1. Null counts as empty text."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = index_vectors()
        for texts in batches:
            x = np.array([pooled(t, model.vectors, index) for t in texts], np.float64).reshape(-1, 3 * WIDTH + 1)
            yield pd.Series(model.network.probability(x))

    return score
