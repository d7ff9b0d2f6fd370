"""Similarity join of documents on their word n-grams, exact, by universe partitioning.

Two sets with a Jaccard similarity of t or more differ in at most H = (|r| + |s|)(1 - t)/(1 + t)
elements. The universe of n-grams is cut by hash into segments, in each band of set sizes so many
that two such sets must agree on a segment (pigeonhole over H + 1 segments), or differ there by
one element where a segment is allotted an error (its one-deletion neighbourhoods are indexed, and
it counts as two). First small sets are indexed with one error per
segment and all others by segment subsets alone (at t = 0.9 about one entry per five elements). The sets of lists that come out long are indexed again under a new cut; how many
segments get an error there follows, band by band, from the cost of the entries against that of
the pairs; lists of a few thousand are compared in place, which costs less still. Candidates pass an exact lower bound on their difference (parity bitmaps) and are then
verified on the words themselves.

Sets that are equal form one class and are joined by one member. In a long list all members are
compared with one of them first; members of one component are not paired with each other again,
so a large group of near copies costs about its size, not its square.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction
from hashlib import blake2b
from math import erf, exp, floor, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barweave.llm.common import Scratch, batches_of, small_batches
from barweave.llm.components import components

LONG_LIST = 8  # pairs of lists up to here are formed at once: at most 3.5 for each of their rows
ENTRIES_PER_BATCH = 10_000
IN_PLACE = 8192  # members of a list whose bitmaps are compared sooner than they are indexed again
SMALL_SET = 40  # up to here a set's own size is about the cost of deletions
COMPARED = 4096  # rows of one block of a long list
SHINGLES_PER_BLOCK = 4_000_000  # and their shingles
SMALL_GROUP = 64  # rows of a group whose pairs of bitmaps are compared at once
BLOCK = 1 << 20  # index entries combined locally before the shuffle
LARGEST_SET = 1 << 40
# Kinds of index rows: one element deleted; passes by the sort; stands for rows that do.
DELETED, HOT, MARK = 1, 2, 4


def words_of(text: str | None) -> list[bytes]:
    """Runs of characters other than space and \\x09-\\x0D, with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []


def shingles(text: str | None, n: int) -> set[tuple]:
    """The set itself: distinct runs of n words; a shorter text is one run; no words, no run."""
    words = words_of(text)
    if len(words) < n:
        return {tuple(words)} if words else set()
    return set(zip(*[words[i:] for i in range(n)]))


def mix(x: np.ndarray) -> np.ndarray:
    """A strong 64-bit mix (constants of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    return mix(x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64)))


def hashed_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs. Only candidates rest on them, never a link."""
    from xxhash import xxh3_64_intdigest

    words = words_of(text)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) < n:
        return np.array([xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64) if len(h) else h
    run = mix(h[: len(h) - n + 1])
    for i in range(1, n):
        run = mix(run + h[i : len(h) - n + 1 + i])
    return np.unique(run)


Plan = tuple[int, int]  # segments without an error, segments with one


class Bands:
    """Size bands for a similarity t: partners of a set are in its own band or in the next ones beside it.

    Band k starts at first[k]. A pair whose larger set is in band k meets in cut k, which both
    sets of band k and of band k - 1 enter.
    """

    def __init__(self, t: Fraction):
        self.first, self.t = [1], t
        while self.first[-1] < LARGEST_SET:
            self.first.append(floor(self.first[-1] / t) + 1)

    def cuts_of(self, size: int) -> list[int]:
        k = bisect_right(self.first, size) - 1
        return [k, k + 1]

    def errors(self, cut: int) -> int:
        """The most elements in which a pair of this cut may differ."""
        return self.most(2 * (self.first[cut + 1] - 1))

    def first_plan(self, cut: int) -> Plan | None:
        """How a cut is indexed at first: small sets by one-deletion neighbourhoods, which cost little
        there and leave few empty segments, others by segments alone. None if only equal sets pair."""
        errors = self.errors(cut)
        if errors == 0:
            return None
        if self.first[cut + 1] <= SMALL_SET:
            return 0, (errors + 2) // 2
        return errors + 1 + spare_segments(self.first[max(0, cut - 1)], errors), 0

    def most(self, total: int) -> int:
        return floor(total * (1 - self.t) / (1 + self.t))


class Plans(dict):
    """First plans by cut, as they are asked for."""

    def __init__(self, bands: Bands):
        super().__init__()
        self.bands = bands

    def __contains__(self, cut: int) -> bool:
        if not super().__contains__(cut):
            self[cut] = self.bands.first_plan(cut)
        return self[cut] is not None


def segment_sums(h: np.ndarray, segments: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment of each element (sorted), the elements' weights in that order, and the sum per segment."""
    at = (seeded(h, seed) % np.uint64(segments)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    weights = seeded(h, seed + 1)[order]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weights, dtype=np.uint64)])
    ends = np.searchsorted(at[order], np.arange(segments + 1))
    return at[order], weights, total[ends[1:]] - total[ends[:-1]]


def entry(sums: np.ndarray, segment: np.ndarray, owner: int) -> np.ndarray:
    """Key of a segment subset inside a cut or a list."""
    return mix(seeded(sums, 5) + mix(segment.astype(np.uint64) + np.uint64(owner % (1 << 64))))


def spare_segments(size: int, errors: int) -> int:
    """Segments beyond errors + 1, so that hardly a set of `size` has more empty ones than that.

    Empty segments agree by chance. With m segments, m - errors at least agree in a pair; a set
    with fewer empty segments than that needs no entries for them, as a filled one agrees too.
    """
    best = (2.0, 0)
    for spare in range(0, 12 + errors // 4):
        m = errors + 1 + spare
        mean = m * exp(-size / m)
        if mean > 500:
            inside = (1 + erf((spare + 0.5 - mean) / sqrt(2 * mean))) / 2
        else:
            inside, term = 0.0, exp(-mean)
            for k in range(spare + 1):
                inside += term
                term *= mean / (k + 1)
        best = min(best, (1 - inside, spare))
        if 1 - inside < 0.003:
            return spare
    return best[1]


def index_entries(h: np.ndarray, bands: Bands, plans: dict[int, Plan], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A set's entries in its two cuts: segment subsets, and those with one element deleted."""
    full, gone = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    for cut in bands.cuts_of(len(h)):
        if cut in plans:
            zeros, ones = plans[cut]
            n = zeros + ones
            at, weights, sums = segment_sums(h, n, seed)
            kept = np.arange(n)
            if not ones:
                filled = np.unique(at)
                if n - len(filled) < n - bands.errors(cut):
                    kept = filled
            full.append(entry(sums[kept], kept, cut << 32 | seed))
            inside = at < ones
            gone.append(entry(sums[at[inside]] - weights[inside], at[inside], cut << 32 | seed))
    return np.concatenate(full), np.concatenate(gone)


def allot(members: int, size: float, apart: float, errors: int) -> tuple[int, int]:
    """How many segments get no error and how many get one, for the least cost.

    The segments must make up errors + 1, where one with an error counts twice. Entries cost one
    each, pairs by the chance that two sets `apart` elements from each other agree.
    """
    best = None
    for ones in sorted({0, *(round((errors + 1) / 2 * f) for f in (0.25, 0.5, 0.75, 1))}):
        zeros = max(0, errors + 1 - 2 * ones)
        n = zeros + ones
        miss = apart / n
        agree = exp(-miss) * (zeros + ones * (1 + miss))
        cost = members * (n + ones * size / n) + members * members / 2 * min(1.0, agree)
        if n and (best is None or cost < best[0]):
            best = cost, zeros, ones
    return best[1], best[2]


def parity_bitmap(h: np.ndarray) -> bytes:
    """A bit per hash value modulo a power of two: whether an odd number of elements has it."""
    bits = max(256, 1 << int(2 * len(h) - 1).bit_length()) if len(h) else 256
    odd = np.bincount((seeded(h, 3) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_apart(a: bytes, b: bytes) -> int:
    """Two sets differ in at least so many elements: each flips one bit."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    nx, ny = 8 * len(a), 8 * len(b)
    while nx != ny:
        if nx > ny:
            nx //= 2
            x = (x >> nx) ^ (x & ((1 << nx) - 1))
        else:
            ny //= 2
            y = (y >> ny) ^ (y & ((1 << ny) - 1))
    return (x ^ y).bit_count()


def folded(bitmaps: pd.Series | np.ndarray) -> np.ndarray:
    """Bitmaps of several lengths as rows of 64-bit words of the shortest length."""
    words = min(len(b) for b in bitmaps) // 8
    rows = [np.bitwise_xor.reduce(np.frombuffer(b, np.uint64).reshape(-1, words), axis=0) for b in bitmaps]
    return np.stack(rows)


def list_pairs(lists: np.ndarray, labels: np.ndarray, deleted: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Pairs (i < j) of rows in the same list, of different components, not both with a deletion.

    Rows are sorted by list; `sizes` is the length of a row's list.
    """
    out = []
    for step in range(1, int(sizes.max(initial=1))):
        same = (lists[step:] == lists[:-step]) & ~(deleted[step:] & deleted[:-step]) & (labels[step:] != labels[:-step])
        out.append(np.stack([np.flatnonzero(same), np.flatnonzero(same) + step]))
    return np.concatenate(out, axis=1) if out else np.empty((2, 0), np.int64)


@dataclass(frozen=True)
class Group:
    """The work on one group of rows inside a task, for runs of n words and similarity t."""

    n: int
    t: Fraction

    def bounded(self, rows: pd.DataFrame, bits: np.ndarray) -> Callable[[np.ndarray, int], np.ndarray]:
        """A function of (component of every row, i): the rows after i that may link with it by the bound, in other components."""
        up, down = self.t.numerator, self.t.denominator
        n, deleted, block = (rows[c].to_numpy() for c in ("n_shingles", "deleted", "block"))
        apart_only = rows["low"].iat[0] != rows["high"].iat[0]

        def of(component: np.ndarray, i: int) -> np.ndarray:
            j = slice(i + 1, None)
            good = (component[j] != component[i]) & (n[j] * down >= n[i] * up) & (n[i] * down >= n[j] * up)
            if deleted[i]:
                good &= ~deleted[j]
            if apart_only:
                good &= block[j] != block[i]
            at = np.flatnonzero(good) + i + 1
            # Where most rows are left, the whole slice is cheaper to compare than a copy of them.
            most = 2 * len(at) > len(good)
            apart = np.bitwise_count((bits[j] if most else bits[at]) ^ bits[i]).sum(axis=1, dtype=np.int64)
            apart = apart[at - i - 1] if most else apart
            return at[apart * (down + up) <= (n[at] + n[i]) * (down - up)]

        return of

    def with_partners(self, rows: pd.DataFrame) -> pd.DataFrame:
        """The rows of a group that have a possible partner in it; no pairs are made."""
        rows = rows.sort_values("id", ignore_index=True)
        bits, label = folded(rows["bitmap"]), rows["label"].to_numpy()
        some, bounded = np.zeros(len(rows), bool), self.bounded(rows, bits)
        label, _ = pd.factorize(label)
        for i in range(len(rows) - 1):
            at = bounded(label, i)
            some[at] = True
            some[i] |= len(at) > 0
        return rows[some]

    def some_partner(
        self, label: np.ndarray, n: np.ndarray, deleted: np.ndarray, block: np.ndarray, bitmap: np.ndarray, apart_only: bool
    ) -> np.ndarray:
        """Which rows of a small group have a possible partner, all pairs of rows at once; `label` numbers their components."""
        up, down = self.t.numerator, self.t.denominator
        i, j = np.triu_indices(len(n), 1)
        good = (label[i] != label[j]) & ~(deleted[i] & deleted[j]) & (n[i] * down >= n[j] * up) & (n[j] * down >= n[i] * up)
        if apart_only:
            good &= block[i] != block[j]
        i, j = i[good], j[good]
        some = np.zeros(len(n), bool)
        if len(i):
            bits = folded(bitmap)
            apart = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
            near = apart * (down + up) <= (n[i] + n[j]) * (down - up)
            some[i[near]] = some[j[near]] = True
        return some

    def partners_in(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """`with_partners` of every group of a stream that is sorted by group. Most groups are small: they are cut
        from the batch as they stand."""
        rest = None
        for batch in batches:
            if len(batch) == 0:
                continue
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            starts = group_starts(rows)
            yield from self._groups(rows, starts)
            rest = rows.iloc[starts[-1] :].reset_index(drop=True)
        if rest is not None:
            yield from self._groups(rest, np.array([0, len(rest)]))

    def _groups(self, rows: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        """Of the groups that begin at `starts`; the last of these begins the rows that are not looked at."""
        fields = [pd.factorize(rows["label"])[0], *(rows[c].to_numpy() for c in ("n_shingles", "deleted", "block", "bitmap"))]
        across, some = (rows["low"] != rows["high"]).to_numpy(), np.zeros(len(rows), bool)
        for first, end in zip(starts[:-1].tolist(), starts[1:].tolist()):
            if end - first > SMALL_GROUP:
                yield self.with_partners(rows.iloc[first:end])
            elif end - first > 1:
                some[first:end] = self.some_partner(*(x[first:end] for x in fields), across[first])
        if some.any():
            yield rows[some]

    def spanning(self, rows: pd.DataFrame) -> pd.DataFrame:
        """Links that join the components of a group, found on the words: fewer than its rows, as what is joined is skipped."""
        up, down, n = self.t.numerator, self.t.denominator, self.n
        rows = rows.sort_values("id", ignore_index=True)
        bits, (component, _) = folded(rows["bitmap"]), pd.factorize(rows["label"])
        ids, texts = rows["id"].to_numpy(), rows["text"].tolist()
        hashes = [hashed_set(t, n) for t in texts]
        out, bounded = [], self.bounded(rows, bits)
        for i in range(len(rows) - 1):
            words = None
            for j in bounded(component, i).tolist():
                if component[i] == component[j]:
                    continue
                same = len(np.intersect1d(hashes[i], hashes[j], assume_unique=True))
                if same * down < up * (len(hashes[i]) + len(hashes[j]) - same):
                    continue
                words, other = shingles(texts[i], n) if words is None else words, shingles(texts[j], n)
                same = len(words & other)
                if same * down >= up * (len(words) + len(other) - same):
                    out.append((ids[i], ids[j]))
                    component[component == component[j]] = component[i]
        return pd.DataFrame(out, columns=["a", "b"])


def group_starts(rows: pd.DataFrame) -> np.ndarray:
    """Where the groups of (list, low, high) begin in rows sorted by them."""
    new = np.zeros(len(rows), bool)
    new[0] = True
    for c in ("list", "low", "high"):
        values = rows[c].to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


class Join:
    """One run of the join; tables go to `room`."""

    def __init__(self, room: Scratch, n: int, t: Fraction, key: str, text: str):
        self.room, self.n, self.t, self.key, self.text = room, n, t, key, text
        self.bands = Bands(t)

    def sets(self, docs: DataFrame) -> DataFrame:
        """key, n_shingles, set_id (equal for equal sets), bitmap; one row per input row."""
        n = self.n
        rows = docs.select(F.col(self.key).alias("key"), F.col(self.text).alias("text"))
        self.kind = rows.schema["key"].dataType.simpleString()

        def build(batches):
            for batch in batches:
                out = []
                for t in batch["text"]:
                    h = hashed_set(t, n)
                    digest = blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None
                    out.append((len(h), digest, parity_bitmap(h)))
                table = pd.DataFrame(out, columns=["n_shingles", "set_id", "bitmap"])
                yield table.assign(key=batch["key"].to_numpy())

        schema = f"key {self.kind}, n_shingles long, set_id binary, bitmap binary"
        return self.room.save(rows.mapInPandas(build, schema), "sets")

    def index(self, members: DataFrame) -> DataFrame:
        """One row per class and list. A list that is long within one block sends its rows there past the
        sort, and one mark in their place; so a task sees few rows per block of any list."""

        n, bands = self.n, self.bands

        def first(batches):
            plans = Plans(bands)
            for batch in batches:
                for key, text in zip(batch["id"], batch["text"]):
                    full, gone = index_entries(hashed_set(text, n), bands, plans, 11)
                    yield key, key, [(full, False), (gone, True)]

        def combine(batches):
            for rows in marked(first(batches)):
                yield rows.drop(columns="label")  # as yet everybody's own

        return members.select("id", "text").mapInPandas(combine, self.entry_schema(""))

    def index_again(self, open_sets: DataFrame, allotted: dict[int, tuple[int, int]]) -> DataFrame:
        """The same for open sets (id, label, text) with errors allotted."""
        n, bands = self.n, self.bands

        def again(batches):
            for batch in batches:
                for key, label, text in zip(batch["id"], batch["label"], batch["text"]):
                    full, gone = index_entries(hashed_set(text, n), bands, allotted, 101)
                    yield key, label, [(full, False), (gone, True)]

        def combine(batches):
            yield from marked(again(batches))

        return open_sets.select("id", "label", "text").mapInPandas(combine, self.entry_schema(f"label {self.kind},"))

    def entry_schema(self, label: str) -> str:
        return f"list long, id {self.kind}, {label} kind int"

    def pairs(self, entries: DataFrame) -> DataFrame:
        """Streams through the lists in order: pairs of short lists (list null), members of long ones (b null).

        Entries already known to be in a long list are spread at random and pass through.
        """
        kind = self.kind
        hot = F.col("kind").bitwiseAND(HOT) > 0
        spread = F.when(hot, F.xxhash64("list", "id", "kind")).otherwise(F.col("list"))
        ordered = entries.repartition(spread).sortWithinPartitions(hot, "list", F.col("kind").desc(), "id")

        def stream(batches):
            rest, long_list = None, None  # rows of the last, unfinished list; the long list we are in
            for batch in batches:
                kinds = batch["kind"].to_numpy()
                hot = kinds & HOT > 0
                batch = batch.assign(deleted=kinds & DELETED > 0, mark=kinds & MARK > 0)
                if "label" not in batch:
                    batch["label"] = batch["id"]
                if hot.any():
                    yield members(batch[hot])
                cold = batch[~hot]
                if len(cold) == 0:
                    continue
                if long_list is not None:
                    inside = (cold["list"] == long_list).to_numpy()
                    yield members(cold[inside & ~cold["mark"].to_numpy(bool)])
                    cold = cold[~inside]
                    if len(cold) == 0:
                        continue
                    long_list = None
                both = cold if rest is None else pd.concat([rest, cold], ignore_index=True)
                last = both["list"].iloc[-1]
                open_rows = (both["list"] == last).to_numpy()
                yield from finish(both[~open_rows])
                rest = both[open_rows]
                if len(rest) > LONG_LIST or rest["mark"].any():
                    yield members(rest[~rest["mark"].to_numpy(bool)])
                    rest, long_list = None, last
            if rest is not None:
                yield from finish(rest)

        def finish(rows: pd.DataFrame):
            if len(rows) < 2:
                return
            lists = rows["list"].to_numpy()
            _, code, many = np.unique(lists, return_inverse=True, return_counts=True)
            marked = np.bincount(code, weights=rows["mark"].to_numpy(bool), minlength=len(many)) > 0
            is_long = ((many > LONG_LIST) | marked)[code]
            plain = rows[is_long & ~rows["mark"].to_numpy(bool)]
            if len(plain):
                yield members(plain)
            short = rows[~is_long & (many[code] > 1)]
            if len(short):
                ids, sizes = short["id"].to_numpy(), many[code][~is_long & (many[code] > 1)]
                i, j = list_pairs(short["list"].to_numpy(), short["label"].to_numpy(), short["deleted"].to_numpy(bool), sizes)
                a, b = ids[i], ids[j]
                swap = a > b
                found = pd.DataFrame({"a": np.where(swap, b, a), "b": np.where(swap, a, b)}).drop_duplicates()
                yield found.assign(list=pd.array([pd.NA] * len(found), "Int64"), deleted=False)

        def members(rows: pd.DataFrame) -> pd.DataFrame:
            none = pd.Series([None] * len(rows), index=rows.index, dtype=object)
            return pd.DataFrame({"a": rows["id"], "b": none, "list": rows["list"], "deleted": rows["deleted"]})

        return ordered.mapInPandas(stream, f"a {kind}, b {kind}, list long, deleted boolean")

    def apart(self, pairs: DataFrame, meta: DataFrame) -> DataFrame:
        """Pairs with the sizes of both sets and the lower bound of their difference."""

        @F.pandas_udf("long")
        def bound(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series([least_apart(p, q) for p, q in zip(x, y)], dtype="int64")

        left = meta.select(F.col("key").alias("a"), F.col("n_shingles").alias("na"), F.col("bitmap").alias("ba"))
        right = meta.select(F.col("key").alias("b"), F.col("n_shingles").alias("nb"), F.col("bitmap").alias("bb"))
        both = pairs.join(left, "a").join(right, "b")
        return both.withColumn("apart", bound("ba", "bb")).drop("ba", "bb")

    def possible(self) -> Column:
        up, down = self.t.numerator, self.t.denominator
        sizes = (F.col("na") * down >= F.col("nb") * up) & (F.col("nb") * down >= F.col("na") * up)
        return sizes & (F.col("apart") * (down + up) <= (F.col("na") + F.col("nb")) * (down - up))

    def verified(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """The pairs (a, b) that link, by the words themselves."""
        n, up, down = self.n, self.t.numerator, self.t.denominator

        def check(batches):
            seen: dict = {}

            def of(key, text):
                if key not in seen:
                    if len(seen) >= 64:
                        seen.clear()
                    seen[key] = (text, shingles(text, n))
                kept, found = seen[key]
                return found if kept == text else shingles(text, n)

            for batch in batches:
                good = []
                for a, b, ta, tb in zip(batch["a"], batch["b"], batch["ta"], batch["tb"]):
                    x, y = of(a, ta), of(b, tb)
                    same = len(x & y)
                    good.append(same * down >= up * (len(x) + len(y) - same))
                yield batch[["a", "b"]][np.array(good, bool)]

        both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(
            texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b"
        )
        return both.select("a", "b", "ta", "tb").mapInPandas(check, f"a {self.kind}, b {self.kind}")

    def star(self, name: str, long_rows: DataFrame, meta: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(rows, measured, links): every member of a long list beside one of them, these pairs once with their
        bounds, and the links among them. Lists of the same sets mostly share their one, so the pairs are few."""
        pivots = long_rows.groupBy("list").agg(F.min("id").alias("a"))
        rows = long_rows.select("list", F.col("id").alias("b")).distinct().join(pivots, "list")
        rows = self.room.save(rows, f"star-{name}")
        measured = self.room.save(self.apart(rows.select("a", "b").distinct(), meta), f"star-apart-{name}")
        near = measured.where(self.possible() & (F.col("a") != F.col("b"))).select("a", "b")
        return rows, measured, self.room.save(self.verified(near, texts), f"star-links-{name}")

    def still_open(self, star: DataFrame, links: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """(lists, labels): long lists that hold several components, and everybody's component so far."""
        labels = components(links, self.room, f"labels-{name}")
        label = F.coalesce("component", F.col("b"))
        named = star.join(labels.withColumnRenamed("id", "b"), "b", "left").select("list", "b", label.alias("label"))
        several = named.groupBy("list").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
        return several.select("list"), labels

    def joined_in_blocks(self, rows: DataFrame, meta: DataFrame, texts: DataFrame, links: DataFrame) -> DataFrame:
        """`links` and those that join what the lists (list, id, deleted) hold apart.

        A list is dealt to blocks of bounded rows and shingles. First the blocks of a sixteenth of
        the lists are worked, then those of the rest, then each two blocks of a list; before each
        step everybody is named anew by the components so far and lists of one component are left
        out, so a large group of near copies, which meets in many lists, is joined early and once.
        A group's bitmaps pick the rows with a possible partner; only these bring their texts.
        """
        kind, group = self.kind, Group(self.n, self.t)
        own = meta.select(F.col("key").alias("id"), "n_shingles", "bitmap")
        known = rows.join(own, "id")
        needed = F.greatest(F.count(F.lit(1)) / F.lit(COMPARED), F.sum("n_shingles") / F.lit(SHINGLES_PER_BLOCK))
        count = known.groupBy("list").agg(F.ceil(needed).cast("int").alias("blocks"))
        dealt = known.join(count, "list").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        dealt = self.room.save(dealt, "dealt")
        alone = dealt.select("*", F.col("block").alias("low"), F.col("block").alias("high"))
        met = dealt.where("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other <> block")
        met = met.select(*dealt.columns, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
        early = F.pmod(F.xxhash64("list"), F.lit(16)) == 0
        fields = f"list long, low int, high int, id {kind}, label {kind}, deleted boolean, block int, n_shingles long, bitmap binary"
        names = [x.split()[0] for x in fields.split(", ")]
        for step, part in (("early", alone.where(early)), ("own", alone.where(~early)), ("cross", met)):
            if part.isEmpty():
                continue
            labels = components(links, self.room, f"labels-{step}")
            part = part.join(labels, "id", "left").withColumn("label", F.coalesce("component", "id"))
            several = part.groupBy("list").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("list")
            by_group = part.join(several, "list", "left_semi").select(*names).repartition("list", "low", "high")
            by_group = by_group.sortWithinPartitions("list", "low", "high")
            near = self.room.save(by_group.mapInPandas(lambda batches: group.partners_in(batches), fields), f"partners-{step}")
            groups = near.join(texts.dropDuplicates(["id"]), "id").groupBy("list", "low", "high")
            more = groups.applyInPandas(lambda rows: group.spanning(rows), f"a {kind}, b {kind}").distinct()
            links = self.room.save(links.unionByName(more), f"links-{step}")
        return links

    def allotment(self, open_star: DataFrame) -> dict[int, tuple[int, int]]:
        """Errors per cut, from the number, size and distance of the open sets in each band.

        One row per band reaches the driver, of which there are at most a few hundred.
        """
        edges = F.array(*[F.lit(x) for x in self.bands.first])
        band = (F.size(F.filter(edges, lambda x: x <= F.col("nb"))) - 1).alias("band")
        sets = open_star.groupBy("b", "nb").agg(F.avg("apart").alias("apart")).select(band, "nb", "apart")
        rows = sets.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.avg("nb").alias("size"), F.avg("apart").alias("apart")).collect()
        seen = {r["band"]: (r["n"], r["size"], r["apart"]) for r in rows}
        out = {}
        for cut in {c for b in seen for c in (b, b + 1)}:
            errors, there = self.bands.errors(cut), [seen[b] for b in (cut - 1, cut) if b in seen]
            members = sum(n for n, _, _ in there)
            size, apart = (sum(t[0] * t[k] for t in there) / members for k in (1, 2))
            if errors:
                zeros, ones = allot(members, size, apart, errors)
                out[cut] = (zeros if ones else zeros + spare_segments(self.bands.first[max(0, cut - 1)], errors)), ones
        return out


def linked_documents(
    docs: DataFrame, room: Scratch, n: int = 5, similarity: float | Fraction = 0.8, key: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(documents, links).

    documents: key, n_shingles, class_id, component, one row per input row. class_id is the
    smallest key with an equal set, component the smallest key reachable over links.
    links: a, b (class_ids), the links found between different sets; they span every component,
    but pairs within long lists that are connected already are not all listed.

    Null or empty text, or text without words, has no shingles, no class and no link: its
    component is its own key. A null key takes part in nothing; its component is null. Rows that
    share a key count as one document with all their links. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    job = Join(room, n, Fraction(similarity).limit_denominator(10_000), key, text)
    sets = job.sets(docs)
    real = sets.where((F.col("n_shingles") > 0) & F.col("key").isNotNull())
    classes = room.save(real.groupBy("set_id").agg(F.min("key").alias("class_id")), "classes")
    own = real.join(classes.withColumnRenamed("class_id", "key"), ["set_id", "key"])
    meta = room.save(own.select("key", "n_shingles", "bitmap").dropDuplicates(["key"]), "meta")
    body = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    members = body.join(meta.select(F.col("key").alias("id")), "id", "left_semi")
    with batches_of(docs.sparkSession, ENTRIES_PER_BATCH):
        found = room.save(job.pairs(job.index(members)), "lists-0")
    near = room.save(
        job.apart(found.where(F.col("b").isNotNull()).select("a", "b").distinct(), meta).where(job.possible()).select("a", "b"),
        "near-0",
    )
    long_rows = found.where(F.col("b").isNull()).select("list", F.col("a").alias("id"))
    wanted = near.select(F.col("a").alias("id")).unionByName(near.select(F.col("b").alias("id")))
    wanted = wanted.unionByName(long_rows.select("id")).distinct()
    texts = room.save(body.join(wanted, "id", "left_semi"), "texts")
    links = room.save(job.verified(near, texts), "links-0")
    if not long_rows.isEmpty():
        star, measured, more = job.star("0", long_rows, meta, texts)
        links = room.save(links.unionByName(more), "links-1")
        lists, labels = job.still_open(star, links, "0")
        open_star = room.save(star.join(lists, "list", "left_semi"), "open")
        size = open_star.groupBy("list").agg(F.count(F.lit(1)).alias("members"))
        short = open_star.join(size.where(F.col("members") <= IN_PLACE), "list", "left_semi")
        longer = open_star.join(size.where(F.col("members") > IN_PLACE), "list", "left_semi")
        rest = short.select("list", F.col("b").alias("id"), F.lit(False).alias("deleted"))
        if not longer.isEmpty():
            named = texts.join(longer.select(F.col("b").alias("id")).distinct(), "id", "left_semi").join(labels, "id", "left")
            found = room.save(job.pairs(job.index_again(named.withColumn("label", F.coalesce("component", "id")), job.allotment(longer.join(measured, ["a", "b"])))), "lists-1")
            pairs = found.where(F.col("b").isNotNull()).select("a", "b").distinct()
            near = job.apart(pairs, meta).where(job.possible()).select("a", "b")
            links = room.save(links.unionByName(job.verified(near, texts)), "links-2")
            # Lists of deletions alone pair nothing.
            full = found.where(F.col("b").isNull() & ~F.col("deleted")).select("list").distinct()
            long_rows = found.where(F.col("b").isNull()).join(full, "list", "left_semi")
            rest = rest.unionByName(long_rows.select("list", F.col("a").alias("id"), "deleted"))
        links = job.joined_in_blocks(rest, meta, texts, links)
    links = links.distinct()
    reached = components(links, room)
    named = classes.join(reached.withColumnRenamed("id", "class_id"), "class_id", "left").select(
        "set_id", "class_id", F.coalesce("component", "class_id").alias("component")
    )
    thin = sets.select("key", "n_shingles", "set_id")
    with_set = thin.where((F.col("n_shingles") > 0) & F.col("key").isNotNull()).join(named, "set_id").drop("set_id")
    without = thin.where((F.col("n_shingles") == 0) | F.col("key").isNull())
    nothing = F.lit(None).cast(job.kind)
    alone = without.select("key", "n_shingles", nothing.alias("class_id"), F.col("key").alias("component"))
    return with_set.select("key", "n_shingles", "class_id", "component").unionByName(alone), links


def marked(sets) -> Iterator[pd.DataFrame]:
    """Index rows of (key, label, [(entries, deleted)]), BLOCK at a time; lists long within a block are marked."""
    held, parts = 0, []
    for key, label, its in sets:
        for e, deleted in its:
            if len(e):
                parts.append((key, label, e, deleted))
                held += len(e)
        if held >= BLOCK:
            yield from _block(parts)
            held, parts = 0, []
    if held:
        yield from _block(parts)


def _block(parts: list) -> Iterator[pd.DataFrame]:
    keys, labels, entries, deleted = zip(*parts)
    many = [len(e) for e in entries]
    lists = np.concatenate([np.asarray(e).view(np.int64) for e in entries])
    order = np.argsort(lists, kind="stable")
    lists = lists[order]
    ids, labels = (np.repeat(pd.Series(list(x)).to_numpy(), many)[order] for x in (keys, labels))
    _, first, size = np.unique(lists, return_index=True, return_counts=True)
    hot = size > LONG_LIST
    kind = np.repeat(np.where(deleted, DELETED, 0), many)[order]
    rows = {"list": lists, "id": ids, "label": labels}
    yield pd.DataFrame(rows | {"kind": (kind | np.repeat(np.where(hot, HOT, 0), size)).astype(np.int32)})
    if hot.any():
        yield pd.DataFrame({k: v[first[hot]] for k, v in rows.items()} | {"kind": np.full(hot.sum(), MARK, np.int32)})
