"""Binary token output with keyed access.

Payload files hold raw ids, all documents in ascending key order, nothing between them. A minimal
perfect hash over the keys leads to each document: keys are dealt to small buckets by hash, each
bucket has one row in the index table with the pilots of its hash function and, per slot, a
fingerprint of the key, the file, and the place in the file. A look-up reads one bucket, computes
one slot, compares the fingerprint and knows where to read; its cost does not grow with the store.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barweave.llm.common import small_batches
from barweave.llm.tokens import encoder, id_type

KEYS_PER_BUCKET = 2000
KEYS_PER_GROUP = 2
PILOTS_AT_ONCE = 64


@dataclass(frozen=True)
class TokenStore:
    """A written store: `folder` has ids/ (payload), entries/, files/ and index/ (Parquet)."""

    folder: str
    dtype: str
    buckets: int

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/{name}")


def write_store(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", special: bool = False
) -> TokenStore:
    """Encode every row and write the store.

    Strings of special tokens in a text are ordinary text, or become their ids with `special`.
    Null text counts as empty; every document gets `end_id` at its end, so none has zero ids.
    Rows with equal keys lie side by side and are told apart by `copy` (0, 1, ...; their order
    follows the text). Null keys come first. An empty table gives a store without files. Other
    columns are not read. A task that is tried again writes a new file; only files of the
    attempts that Spark commits are named in the tables.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ids_folder = f"{folder}/ids"
    dtype = _dtype(tokenizer)
    order = [F.col("key").asc_nulls_first(), F.col("text").asc_nulls_first()]
    ordered = (
        docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
        .repartitionByRange(order[0])
        .sortWithinPartitions(*order)
    )
    kind = ordered.schema["key"].dataType.simpleString()

    def write(batches):
        encode = encoder(tokenizer, special=special).encode
        end = np.array([end_id], dtype).tobytes()
        width = np.dtype(dtype).itemsize
        name, out, place, last, copy = "", None, 0, None, 0
        try:
            for batch in batches:
                if out is None:
                    name = f"{uuid.uuid4().hex}.bin"
                    out = _open_new(ids_folder, name)
                places, lengths, copies = [], [], []
                for k, t in zip(batch["key"], batch["text"]):
                    payload = (encode(t) if isinstance(t, str) else b"") + end
                    out.write(payload)
                    same = place > 0 and (k == last or (pd.isna(k) and pd.isna(last)))
                    copy = copy + 1 if same else 0
                    last = k
                    places.append(place)
                    lengths.append(len(payload) // width)
                    copies.append(copy)
                    place += lengths[-1]
                yield pd.DataFrame(
                    {"key": batch["key"], "copy": copies, "file": name, "place": places, "length": lengths}
                )
        finally:
            if out is not None:
                out.close()

    entries = ordered.mapInPandas(write, f"key {kind}, copy long, file string, place long, length long")
    entries.write.parquet(f"{folder}/entries")
    entries = spark.read.parquet(f"{folder}/entries")

    files = entries.groupBy("file").agg(
        F.min("key").alias("first_key"), F.sum("length").alias("n_ids"), F.count(F.lit(1)).alias("n_docs")
    )
    earlier = Window.orderBy(F.col("first_key").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    files.withColumn("start", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).cast("long")).write.parquet(
        f"{folder}/files"
    )

    n_keys = entries.count()
    store = TokenStore(folder, dtype, max(1, -(-n_keys // KEYS_PER_BUCKET)))
    hashed = _hashed(entries, store).select("bucket", "h1", "h2", "file", "place", "length")
    hashed.groupBy("bucket").applyInPandas(
        _index_bucket, "bucket long, n long, pilots binary, prints binary, files array<string>, slots binary"
    ).write.parquet(f"{folder}/index")
    return store


def look_up(store: TokenStore, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """Where each key's ids are: key, copy, file, place, length; keys not in the store are left out.

    `keys` may have a column `copy`; without it the first copy is meant. Repeated keys repeat.
    """
    spark = keys.sparkSession
    copy = F.col("copy").cast("long") if "copy" in keys.columns else F.lit(0).cast("long")
    wanted = _hashed(keys.select(F.col(key).alias("key"), copy.alias("copy")), store)
    kind = wanted.schema["key"].dataType.simpleString()
    asked = wanted.groupBy("bucket")
    return asked.cogroup(store.table(spark, "index").groupBy("bucket")).applyInPandas(
        _find, f"key {kind}, copy long, file string, place long, length long"
    )


def read_ids(store: TokenStore, places: DataFrame) -> DataFrame:
    """The ids at `places` (columns of look_up) as binary of little-endian unsigned 32-bit integers.

    Adds `start`, the ids of all documents before it in the store. Each file is read by one task,
    from front to back.
    """
    spark = places.sparkSession
    kind = places.schema["key"].dataType.simpleString()
    folder, dtype = f"{store.folder}/ids", store.dtype

    def read(batches):
        width = np.dtype(dtype).itemsize
        name, source = None, None
        for batch in batches:
            ids = []
            for file, place, length in zip(batch["file"], batch["place"], batch["length"]):
                if file != name:
                    name, source = file, _open_old(folder, file)
                source.seek(place * width)
                ids.append(np.frombuffer(source.read(length * width), dtype).astype("<u4").tobytes())
            yield batch.assign(ids=ids)

    lined_up = places.repartition("file").sortWithinPartitions("file", "place")
    rows = lined_up.mapInPandas(read, f"key {kind}, copy long, file string, place long, length long, ids binary")
    starts = store.table(spark, "files").select("file", F.col("start").alias("_start"))
    return rows.join(starts, "file").withColumn("start", F.col("_start") + F.col("place")).drop("_start", "file", "place")


def get(spark: SparkSession, store: TokenStore, key, copy: int = 0) -> np.ndarray | None:
    """The ids of one document, or None: one index row and one range of one file are read."""
    asked = spark.createDataFrame([(key,)], f"key {store.table(spark, 'entries').schema['key'].dataType.simpleString()}")
    row = _hashed(asked.withColumn("copy", F.lit(copy).cast("long")), store).first()
    bucket = store.table(spark, "index").where(F.col("bucket") == row["bucket"]).toPandas()
    found = _find(pd.DataFrame([row.asDict()]), bucket)
    if found.empty:
        return None
    hit, width = found.iloc[0], np.dtype(store.dtype).itemsize
    with _open_old(f"{store.folder}/ids", hit["file"]) as source:
        source.seek(int(hit["place"]) * width)
        return np.frombuffer(source.read(int(hit["length"]) * width), store.dtype)


def _dtype(tokenizer: str) -> str:
    from tokenizers import Tokenizer

    return id_type(Tokenizer.from_file(tokenizer).get_vocab_size(True))


def _open_new(folder: str, name: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    return system.open_output_stream(f"{path}/{name}", buffer_size=1 << 20)


def _open_old(folder: str, name: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    return system.open_input_file(f"{path}/{name}")


def _hashed(keys: DataFrame, store: TokenStore) -> DataFrame:
    """Two independent hashes of (key, copy), and the bucket."""
    h = [F.xxhash64("key", "copy", F.lit(seed)) for seed in (1, 2)]
    bucket = F.pmod(F.xxhash64("h1", F.lit(3)), F.lit(store.buckets)).cast("long")
    return keys.withColumn("h1", h[0]).withColumn("h2", h[1]).withColumn("bucket", bucket)


def _mix(x: np.ndarray) -> np.ndarray:
    """A strong 64-bit mix (constants of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slot(h1, h2, pilot, n: int) -> np.ndarray:
    return (_mix(h1 ^ _mix(h2 + pilot)) % np.uint64(n)).astype(np.int64)


def build_pilots(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pilots of a minimal perfect hash over distinct (h1, h2), and the slot of each key.

    Keys form small groups; from the largest group on, a pilot is sought that sends the whole
    group to free slots. A group of one key notes a free slot itself, as a negative number.
    """
    n = len(h1)
    groups = max(1, n // KEYS_PER_GROUP)
    group = (_mix(h1 + h2) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    ends = np.cumsum(np.bincount(group, minlength=groups))
    pilots, slots, free = np.zeros(groups, np.int64), np.full(n, -1, np.int64), np.ones(n, bool)
    sizes = np.diff(ends, prepend=0)
    for g in np.argsort(-sizes, kind="stable"):
        keys = order[ends[g] - sizes[g] : ends[g]]
        if len(keys) < 2:
            break
        first = 0
        while True:
            tries = np.arange(first, first + PILOTS_AT_ONCE, dtype=np.uint64)
            at = np.sort(_slot(h1[keys], h2[keys], tries[:, None], n), axis=1)
            good = free[at].all(axis=1) & (np.diff(at, axis=1) > 0).all(axis=1)
            if good.any():
                pilots[g] = first + int(good.argmax())
                break
            first += PILOTS_AT_ONCE
        slots[keys] = _slot(h1[keys], h2[keys], np.uint64(pilots[g]), n)
        free[slots[keys]] = False
    lone = np.flatnonzero(sizes == 1)
    left = np.flatnonzero(free)
    pilots[lone] = -left - 1
    slots[order[ends[lone] - 1]] = left
    return pilots, slots


def find_slots(pilots: np.ndarray, n: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    pilot = pilots[(_mix(h1 + h2) % np.uint64(len(pilots))).astype(np.int64)]
    return np.where(pilot < 0, -pilot - 1, _slot(h1, h2, np.maximum(pilot, 0).astype(np.uint64), n))


def _prints(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return (_mix(h2 ^ (h1 << np.uint64(1))) >> np.uint64(32)).astype("<u4")


def _unsigned(column: pd.Series) -> np.ndarray:
    return column.to_numpy(np.int64).view(np.uint64)


def _index_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    h1, h2 = _unsigned(rows["h1"]), _unsigned(rows["h2"])
    pilots, slots = build_pilots(h1, h2)
    files, codes = np.unique(rows["file"].to_numpy(object), return_inverse=True)
    table = np.zeros((3, len(rows)), "<i8")
    table[:, slots] = [codes, rows["place"], rows["length"]]
    prints = np.zeros(len(rows), "<u4")
    prints[slots] = _prints(h1, h2)
    return pd.DataFrame(
        {
            "bucket": [int(rows["bucket"].iloc[0])], "n": [len(rows)], "pilots": [pilots.astype("<i4").tobytes()],
            "prints": [prints.tobytes()], "files": [list(files)], "slots": [table.tobytes()],
        }
    )


def _find(asked: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    none = asked[["key", "copy"]].head(0).assign(file="", place=0, length=0)
    if asked.empty or index.empty:
        return none
    bucket = index.iloc[0]
    n, pilots = int(bucket["n"]), np.frombuffer(bucket["pilots"], "<i4").astype(np.int64)
    h1, h2 = _unsigned(asked["h1"]), _unsigned(asked["h2"])
    slots = find_slots(pilots, n, h1, h2)
    known = np.frombuffer(bucket["prints"], "<u4")[slots] == _prints(h1, h2)
    codes, places, lengths = np.frombuffer(bucket["slots"], "<i8").reshape(3, n)[:, slots]
    files = np.array(list(bucket["files"]), object)[codes]
    return asked[["key", "copy"]].assign(file=files, place=places, length=lengths)[known]
