"""Packing documents into sequences of a fixed number of tokens, by best-fit decreasing per task.

Only documents longer than a sequence are cut. Pieces are dealt at random to tasks of a bounded
number of pieces; a task takes its pieces from the longest down and puts each into the open
sequence it fills best. As many sequences may be open as a task has pieces; `best_fit` with a
lower bound closes the fullest beyond it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barweave.llm.common import Scratch, small_batches
from barweave.llm.tokens import encoder

OPEN_BINS = 32_768
PIECES_PER_TASK = 32_768


class Bins:
    """Open sequences by free space: a bit per free space that occurs, and the sequences that have it."""

    def __init__(self, capacity: int, most: int = OPEN_BINS):
        self.capacity, self.most = capacity, most
        self.bits, self.open, self.made = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, length: int) -> tuple[int, int]:
        """Sequence and offset of a piece of 1..capacity tokens."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, number = self.capacity, self.made
            self.made += 1
        if free > length:
            self._give(free - length, number)
        return number, self.capacity - free

    def _take(self, free: int) -> int:
        number = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return number

    def _give(self, free: int, number: int) -> None:
        self.by_free[free].append(number)
        self.bits |= 1 << free
        self.open += 1


@dataclass(frozen=True)
class Packed:
    """pieces: key, row, piece, start, length, ids; places: row, piece, sequence_id, offset.

    `row` numbers the input rows, so that repeated or null keys stay apart. `ids` are
    little-endian unsigned 32-bit integers.
    """

    pieces: DataFrame
    places: DataFrame

    def sequences(self) -> DataFrame:
        """One row per sequence with the ids of its pieces joined, and the pieces' keys in order."""
        both = self.pieces.join(self.places, ["row", "piece"])
        inside = F.array_sort(F.collect_list(F.struct("offset", "key", "ids")))
        grown = both.groupBy("sequence_id").agg(inside.alias("p"))
        joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
        return grown.select("sequence_id", F.col("p.key").alias("keys"), joined.alias("ids"))


def pack(
    docs: DataFrame, room: Scratch, tokenizer: str, end_id: int, capacity: int = 1024,
    key: str = "doc_id", text: str = "text", special: bool = False,
) -> Packed:
    """Encode and pack every row; the two result tables are written to `room`.

    Strings of special tokens in a text are ordinary text, or become their ids with `special`.
    Null text counts as empty (one piece of the end id alone). A document of more than `capacity`
    ids is cut into pieces of `capacity`, the first of which may be shorter. Repeated rows are
    packed as often as they come; an empty table gives no pieces; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def cut(batches):
        encode = encoder(tokenizer, "<u4", special).encode
        end = np.array([end_id], "<u4").tobytes()
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            out = []
            for k, t in zip(batch["key"], batch["text"]):
                ids = (encode(t) if isinstance(t, str) else b"") + end
                for number, (start, stop) in enumerate(cuts(len(ids) // 4, capacity)):
                    out.append((k, row, number, start, stop - start, ids[4 * start : 4 * stop]))
                row += 1
            names = ["key", "row", "piece", "start", "length", "ids"]
            yield pd.DataFrame(out, columns=names).astype({"key": batch["key"].dtype})

    schema = f"key {kind}, row long, piece int, start long, length long, ids binary"
    pieces = room.save(rows.mapInPandas(cut, schema), "pieces")

    def fill(batches):
        base, bins = TaskContext.get().partitionId() << 40, Bins(capacity)
        for batch in batches:
            put = [bins.put(length) for length in batch["length"].tolist()]
            at = np.array(put, np.int64).reshape(-1, 2)
            yield batch[["row", "piece"]].assign(sequence_id=base + at[:, 0], offset=at[:, 1])

    tasks = max(1, -(-pieces.count() // PIECES_PER_TASK))
    dealt = (
        pieces.select("row", "piece", "length")
        .repartition(tasks, F.xxhash64("row", "piece"))
        .sortWithinPartitions(F.col("length").desc(), "row", "piece")
    )
    places = room.save(dealt.mapInPandas(fill, "row long, piece int, sequence_id long, offset long"), "places")
    return Packed(pieces, places)


def cuts(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """Ranges of the pieces of a document of n ids."""
    first = n if n <= capacity else n % capacity or capacity
    yield 0, first
    for start in range(first, n, capacity):
        yield start, start + capacity


def best_fit(lengths: Iterable[int], capacity: int, most: int = OPEN_BINS) -> list[tuple[int, int]]:
    bins = Bins(capacity, most)
    return [bins.put(n) for n in lengths]
