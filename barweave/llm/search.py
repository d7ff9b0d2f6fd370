"""Ranked lexical search over an inverted index in shards, by Block-Max MaxScore.

A shard holds the postings of a bounded run of documents, sorted by term and document and cut into
blocks. A block is compressed on its own; beside it stand its last document and its competitive
(frequency, length) pairs: those that no other pair of the block beats in both. They bound the
block's scores whatever the statistics of the corpus turn out to be, so one pass over the texts
builds the index, and the statistics are summed from the shards.

A search partitions a query's lists by their largest scores: lists that together cannot reach the
current tenth score are not essential, and only documents of the others are candidates. Bounds of
blocks on the non-essential lists then reject candidates before those blocks are decompressed.
Each shard returns its best documents, and these heaps are merged.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import floor, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from barweave.llm.common import Scratch, small_batches

BLOCK = 128
TOKENS_PER_SHARD = 2_000_000
QUERIES_PER_PASS = 2000
TERMS_PER_PASS = 200_000
# Fixed values of the score.
SCALE, PART, K1 = 1_000_000_000, 1000, 8
INDEX = pa.schema([
    ("shard", pa.int64()), ("term", pa.string()), ("df", pa.int32()), ("lasts", pa.binary()), ("tops", pa.binary()), ("counts", pa.binary()),
    ("ends", pa.binary()), ("payload", pa.binary()), ("doc_rows", pa.binary()), ("doc_lengths", pa.binary()), ("n_docs", pa.int64()), ("n_terms", pa.int64()),
])
INDEX_DDL = (
    "shard long, term string, df int, lasts binary, tops binary, counts binary, ends binary, payload binary,"
    " doc_rows binary, doc_lengths binary, n_docs long, n_terms long"
)
# Terms are runs of these after lower-casing A-Z.
_TERM_BYTE = bytes(b if b >= 0x80 or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    if not isinstance(text, str):
        return []
    return text.encode("utf-8", "surrogatepass").lower().translate(_TERM_BYTE).split()


def pack_varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values, seven bits each with the top bit set but for the last, and each value's number of bytes."""
    sizes = np.ones(len(values), np.int64)
    for bits in (7, 14, 21, 28):
        sizes += values >= (1 << bits)
    out = np.empty(int(sizes.sum()), np.uint8)
    ends = np.cumsum(sizes)
    for i in range(5):
        here = sizes > i
        left = sizes[here] - i - 1
        out[ends[here] - sizes[here] + i] = (values[here] >> (7 * i)) & 0x7F | np.where(left > 0, 0x80, 0)
    return out, sizes


def unpack_varints(raw: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(raw < 0x80)
    starts = np.concatenate(([0], last[:-1] + 1))
    place = np.arange(len(raw)) - np.repeat(starts, last - starts + 1)
    return np.add.reduceat((raw & 0x7F).astype(np.int64) << (7 * place), starts) if len(last) else np.empty(0, np.int64)


class ShardBuilder:
    """Documents of one shard, as term numbers."""

    def __init__(self):
        self.vocabulary: defaultdict[bytes, int] = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.ids: list[np.ndarray] = []
        self.rows: list[int] = []
        self.n_tokens = 0

    def add(self, row: int, terms: list[bytes]) -> None:
        self.ids.append(np.fromiter(map(self.vocabulary.__getitem__, terms), np.int64, len(terms)))
        self.rows.append(row)
        self.n_tokens += len(terms)

    def batch(self, shard: int) -> pa.RecordBatch:
        """The shard's rows of the index: one without a term for its documents, then one per term."""
        # By ascending key, so that among equal scores the first document visited wins.
        order = np.argsort(np.array(self.rows, np.int64), kind="stable")
        self.rows, self.ids = [self.rows[i] for i in order], [self.ids[i] for i in order]
        lengths = np.array([len(x) for x in self.ids], np.int64)
        n = len(lengths)
        pairs, tf = np.unique(np.concatenate(self.ids) * n + np.repeat(np.arange(n), lengths), return_counts=True)
        term, doc = pairs // n, pairs % n
        first = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
        df = np.diff(np.append(first, len(term)))
        in_list = np.arange(len(term)) - np.repeat(first, df)
        opens = in_list % BLOCK == 0
        block_first = np.flatnonzero(opens)
        block_last = np.append(block_first[1:], len(term)) - 1
        gap = np.where(opens, doc, doc - np.concatenate(([0], doc[:-1])))
        packed, sizes = pack_varints(np.stack([gap, tf], 1).reshape(-1))
        posting_end = np.cumsum(sizes.reshape(-1, 2).sum(1))
        block_end = posting_end[block_last]
        list_first = np.flatnonzero(opens[block_first] & (in_list[block_first] == 0))
        n_blocks = np.diff(np.append(list_first, len(block_first)))
        list_start = np.concatenate(([0], block_end))[list_first]
        tops, counts = competitive(tf, lengths[doc], np.repeat(np.arange(len(block_first)), block_last - block_first + 1))
        top_ends = np.cumsum(counts)[list_first + n_blocks - 1]

        def lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
            offsets = np.concatenate(([0, 0], ends * values.itemsize)).astype(np.int32)  # the first row holds no list
            return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])

        blocks_end = np.cumsum(n_blocks)
        names = list(self.vocabulary)  # in the order of their numbers
        rest = len(first)
        columns = [
            pa.array(np.full(rest + 1, shard, np.int64)),
            pa.array([None, *[x.decode("utf-8", "surrogatepass") for x in names]], pa.string()),
            pa.array(np.concatenate(([0], df)).astype(np.int32)),
            lists(doc[block_last].astype(np.int32), blocks_end),
            lists(tops.astype(np.int32), top_ends * 2),
            lists(counts.astype(np.int32), blocks_end),
            lists((block_end - np.repeat(list_start, n_blocks)).astype(np.int32), blocks_end),
            lists(packed, block_end[list_first + n_blocks - 1]),
            pa.array([np.array(self.rows, np.int64).tobytes(), *[None] * rest], pa.binary()),
            pa.array([lengths.astype(np.int32).tobytes(), *[None] * rest], pa.binary()),
            pa.array([n, *[None] * rest], pa.int64()),
            pa.array([int(lengths.sum()), *[None] * rest], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=INDEX)


def competitive(tf: np.ndarray, length: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frequency, length) pairs that no other of their block beats in both, flat and block by block, and their number per block."""
    order = np.lexsort((-tf, length, block))
    t, b = tf[order].astype(np.int64), block[order]
    # Shortest first: a pair competes when its frequency exceeds all before it in the block.
    step = int(t.max()) + 1
    best = np.maximum.accumulate(t + b * step) - b * step
    keep = np.concatenate(([True], (b[1:] != b[:-1]) | (t[1:] > best[:-1])))
    pairs = np.stack([t[keep], length[order][keep]], 1).reshape(-1)
    return pairs, np.bincount(b[keep], minlength=int(block[-1]) + 1)


def build_index(docs: DataFrame, room: Scratch, key: str = "doc_id", text: str = "text", tokens: int = TOKENS_PER_SHARD) -> DataFrame:
    """The index of all rows: per shard one row for its documents (term null) and one per term.

    A shard closes after the document with which it reaches `tokens` terms, so it is bounded but
    for one document. Documents without terms (null and empty texts) are in no shard. Rows that
    repeat a key are documents of their own; a null key is kept as it is.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, made = TaskContext.get().partitionId() << 32, ShardBuilder()
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if found := terms_of(body):
                    made.add(NO_KEY if name is None else name, found)
                    if made.n_tokens >= tokens:
                        yield made.batch(shard)
                        shard, made = shard + 1, ShardBuilder()
        if made.rows:
            yield made.batch(shard)

    return room.save(rows.mapInArrow(build, INDEX_DDL), "index")


NO_KEY = (1 << 63) - 1  # stands for a null key inside the index, and comes last


@dataclass(frozen=True)
class Corpus:
    n_docs: int
    n_terms: int

    def weight(self, df: int) -> int:
        return floor(1000 * log((2 * self.n_docs + 2) / (2 * df + 1)))

    def norm(self, lengths: np.ndarray) -> np.ndarray:
        return 100 - 75 + (75 * lengths.astype(np.int64) * self.n_docs) // self.n_terms


def saturation(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return (SCALE * tf) // (PART * tf + K1 * norm)


class PostingList:
    """One term of a shard. Blocks are decompressed when they are first asked for."""

    def __init__(self, row, corpus: Corpus, norms: np.ndarray):
        self.lasts = np.frombuffer(row.lasts, np.int32)
        pairs = np.frombuffer(row.tops, np.int32).reshape(-1, 2)
        counts = np.frombuffer(row.counts, np.int32)
        reach = saturation(pairs[:, 0], corpus.norm(pairs[:, 1]))
        self.tops = np.maximum.reduceat(reach, np.concatenate(([0], np.cumsum(counts)[:-1])))
        self.top = int(self.tops.max())
        self.ends = np.frombuffer(row.ends, np.int32)
        self.payload, self.norms, self.blocks = np.frombuffer(row.payload, np.uint8), norms, {}
        self.decompressed = 0

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a block and what each adds per unit of weight."""
        if i not in self.blocks:
            start = int(self.ends[i - 1]) if i else 0
            values = unpack_varints(self.payload[start : int(self.ends[i])]).reshape(-1, 2)
            docs = np.cumsum(values[:, 0])
            self.blocks[i] = docs, saturation(values[:, 1], self.norms[docs])
            self.decompressed += 1
        return self.blocks[i]

    def blocks_between(self, low: int, high: int) -> range:
        """Blocks that may hold documents from low to high (exclusive)."""
        return range(int(np.searchsorted(self.lasts, low)), min(len(self.lasts), int(np.searchsorted(self.lasts, high - 1)) + 1))


def best_of_shard(lists: list[tuple[int, PostingList]], n_docs: int, k: int, window: int = 1024) -> list[tuple[int, int]]:
    """The k best (score, document) of one shard for (weight, list) pairs, by Block-Max MaxScore.

    Documents are visited in ascending order, a window at a time, so among equal scores the first
    stay; a candidate whose bound only equals the k-th score is rejected.
    """
    lists = sorted(((w, x) for w, x in lists if w > 0), key=lambda p: p[0] * p[1].top)
    reach = np.cumsum([0] + [w * x.top for w, x in lists])  # of the first lists together
    heap: list[tuple[int, int]] = []  # (score, -document)
    scores = np.zeros(window, np.int64)
    for low in range(0, n_docs, window):
        high = min(n_docs, low + window)
        least = heap[0][0] if len(heap) == k else 0
        # Essential lists start where the lists before them can beat the k-th score for the first time.
        split = int(np.searchsorted(reach[1:], least, side="right"))
        if split == len(lists):
            break  # no list is essential: nothing can enter any more
        scores[:] = 0
        for w, x in lists[split:]:
            for i in x.blocks_between(low, high):
                docs, adds = x.block(i)
                if docs[0] < low or docs[-1] >= high:
                    inside = slice(*np.searchsorted(docs, (low, high)))
                    docs, adds = docs[inside], adds[inside]
                scores[docs - low] += w * adds
        found = np.flatnonzero(scores)
        for j in range(split - 1, -1, -1):
            found = found[scores[found] + reach[j + 1] > least]
            if not len(found):
                break
            w, x = lists[j]
            at = np.searchsorted(x.lasts, found + low)
            inside = at < len(x.lasts)
            bound = np.zeros(len(found), np.int64)
            bound[inside] = w * x.tops[at[inside]]
            live = scores[found] + bound + reach[j] > least
            found, at, inside = found[live], at[live], inside[live]
            for i in np.unique(at[inside]):
                docs, adds = x.block(int(i))
                mine = found[at == i]
                place = np.minimum(np.searchsorted(docs, mine + low), len(docs) - 1)
                hit = docs[place] == mine + low
                scores[mine[hit]] += w * adds[place[hit]]
        for d in found[scores[found] > least]:
            entry = (int(scores[d]), -(low + int(d)))
            if len(heap) < k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
    return [(score, -d) for score, d in heap]


def query_blocks(queries: DataFrame, key: str, text: str) -> Iterator[list[tuple[int, object, dict[bytes, int]]]]:
    """(number, key, terms with their repeats) of all queries, in blocks of a bounded size."""
    block, size = [], 0
    rows = queries.select(F.col(key).alias("key"), F.col(text).alias("text")).orderBy("key", "text")
    for i, row in enumerate(rows.toLocalIterator()):
        repeats: dict[bytes, int] = {}
        for t in terms_of(row.text):
            repeats[t] = repeats.get(t, 0) + 1
        if not repeats:
            continue
        block.append((i, row.key, repeats))
        size += len(repeats)
        if len(block) >= QUERIES_PER_PASS or size >= TERMS_PER_PASS:
            yield block
            block, size = [], 0
    if block:
        yield block


def search(index: DataFrame, queries: DataFrame, k: int = 10, key: str = "item_id", text: str = "text") -> DataFrame:
    """item, rank (from 1), doc_id, score: the k best documents of every query with a score above 0.

    Equal scores go by ascending doc_id, null ids last. Every query row is a query of its own, so a
    repeated item is ranked once per row; queries without terms, and those that match nothing,
    give no rows; an empty index gives none. Queries pass through the driver in bounded blocks.
    """
    spark = index.sparkSession
    kind = queries.schema[key].dataType
    none = spark.createDataFrame([], f"item {kind.simpleString()}, rank int, doc_id long, score long")
    totals = index.where("term IS NULL").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_terms").alias("n_terms")).first()
    if not totals.n_docs:
        return none
    corpus = Corpus(totals.n_docs, totals.n_terms)
    return reduce(DataFrame.unionByName, (_search_block(index, block, corpus, k, kind) for block in query_blocks(queries, key, text)), none)


def _search_block(index: DataFrame, block: list, corpus: Corpus, k: int, kind: DataType) -> DataFrame:
    spark = index.sparkSession
    wanted = sorted({t.decode("utf-8", "surrogatepass") for _, _, repeats in block for t in repeats})
    words = F.broadcast(spark.createDataFrame([(t,) for t in wanted], "term string"))  # at most TERMS_PER_PASS
    lists = index.join(words, "term", "left_semi")
    df = {r.term: r.df for r in lists.groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator()}
    weights = {t: corpus.weight(n) for t, n in df.items()}
    asked = []
    for number, _, repeats in block:
        named = {t.decode("utf-8", "surrogatepass"): n for t, n in repeats.items()}
        asked.append((number, {t: n * weights[t] for t, n in named.items() if t in weights}))

    def search_shard(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[rows["term"].isna()].iloc[0]
        names, norms = np.frombuffer(own.doc_rows, np.int64), corpus.norm(np.frombuffer(own.doc_lengths, np.int32))
        found = {r.term: PostingList(r, corpus, norms) for r in rows[rows["term"].notna()].itertuples()}
        out = []
        for number, terms in asked:
            best = best_of_shard([(w, found[t]) for t, w in terms.items() if t in found], len(names), k)
            out += [(number, int(names[d]), score) for score, d in best]
        return pd.DataFrame(out, columns=["number", "doc", "score"]).astype("int64")

    documents = index.where("term IS NULL")
    columns = ["shard", "term", "lasts", "tops", "counts", "ends", "payload", "doc_rows", "doc_lengths"]
    heaps = lists.select(*columns).unionByName(documents.select(*columns)).groupBy("shard").applyInPandas(search_shard, "number long, doc long, score long")
    order = Window.partitionBy("number").orderBy(F.desc("score"), "doc")
    ranked = heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    items = F.broadcast(spark.createDataFrame([(number, item) for number, item, _ in block], f"number long, item {kind.simpleString()}"))
    return ranked.join(items, "number").select("item", "rank", F.when(F.col("doc") != NO_KEY, F.col("doc")).alias("doc_id"), "score")

