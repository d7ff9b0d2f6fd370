"""Repeated passages across the corpus: the earliest stays, the rest goes.

Texts are cut into units: sentences that also end at line ends, whole lines or whole paragraphs.
Normalised units are hashed, digests are grouped over all rows, and of equal units the earliest
stays. A later one is removed only where it stands in a run of repeated units that has enough
words in all, so that common short units do no harm while passages go whatever surrounds them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barweave.llm.common import small_batches

# A unit holds its end mark; what follows, white space included, belongs to the next one. Sentences end after their mark
# where white space follows, after a full-width mark, and after a line feed. No text is lost between units.
SENTENCES = re.compile(
    r"(?:[^\n.!?。！？]++|[.!?]+(?![.!?\x09-\x0D\x20]))*(?:\n|[.!?]+(?=[\x09-\x0D\x20])|[。！？]|\Z)"
)
LINES = re.compile(r"[^\n]*(?:\n|\Z)")
PARAGRAPHS = re.compile(r"(?:[^\n]++|\n(?!\n))*(?:\n\n+|\Z)")
LEAST_WORDS = 30  # of a removed run
SALTS = 16


def units_of(text: str, border: re.Pattern = SENTENCES) -> list[str]:
    return [u for u in border.findall(text) if u]


def words_in(unit: str) -> list[bytes]:
    """A-Z lower-cased words between \\x20 and \\x09-\\x0D."""
    return unit.encode("utf-8", "surrogatepass").lower().split()


def runs(units: list[str], repeated: set[int], least: int) -> list[tuple[int, int]]:
    """(first, last exclusive) of the runs of repeated units with `least` words or more. Units without words do not end a run."""
    found, first, last, words = [], None, 0, 0
    for i, u in enumerate([*units, None]):
        n = 0 if u is None else len(words_in(u))
        if u is not None and i in repeated:
            first, last, words = i if first is None else first, i + 1, words + n
        elif u is None or n:
            if first is not None and words >= least:
                found.append((first, last))
            first, words = None, 0
    return found


def repeated_units(
    docs: DataFrame, key: str = "doc_id", text: str = "text", border: re.Pattern = SENTENCES, least: int = LEAST_WORDS
) -> DataFrame:
    """One row per input row: key, n_units, text (what stays), removed: array of (start, end, units).

    start and end are code points of the original text, `units` is how many went there. Of equal
    units over all rows the one of the smallest key stays (a null key comes last), within a row the
    first. Rows that share a key and text are repeats of each other: the first in no fixed order
    stays. Null text gives null text and no units, empty text none. An empty table gives an empty
    result; other columns are not read. `docs` is read more than once and has to be a stored table;
    rows are told apart by their number in it.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("row", F.monotonically_increasing_id())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, numbers, digests = [], [], []
            for at, body in enumerate(batch.column(1).to_pylist()):
                for i, unit in enumerate(units_of(body, border)):
                    if words := words_in(unit):
                        owners.append(at)
                        numbers.append(i)
                        digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
            where = pa.array(owners, pa.int64())
            columns = [batch.column(0).take(where), batch.column(2).take(where), pa.array(numbers, pa.int32()), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "row", "unit", "digest"])

    kind = rows.schema["key"].dataType.simpleString()
    flat = rows.where("text IS NOT NULL").mapInArrow(cut, f"key {kind}, row long, unit int, digest binary")
    rank = F.struct(F.col("key").isNull().alias("no"), "key", "row", "unit")
    first = flat.groupBy("digest").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # One row per digest meets all its units: it is laid out for every salt, and the units are dealt by their salt.
    first = first.select("digest", F.col("first.row").alias("first_row"), F.col("first.unit").alias("first_unit"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = flat.select("row", "unit", "digest", F.pmod(F.col("row") + F.col("unit"), F.lit(SALTS)).cast("int").alias("salt"))
    again = dealt.join(first, ["digest", "salt"]).where((F.col("row") != F.col("first_row")) | (F.col("unit") != F.col("first_unit")))
    gone = again.groupBy("row").agg(F.collect_set("unit").alias("gone"))

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, body, repeated in zip(batch["key"], batch["text"], batch["gone"]):
                units = [] if body is None else units_of(body, border)
                places, stays, removed = [0], [], []
                for u in units:
                    places.append(places[-1] + len(u))
                at = 0
                for a, b in runs(units, set(repeated), least) if repeated is not None else []:
                    removed.append({"start": places[a], "end": places[b], "units": b - a})
                    stays += units[at:a]
                    at = b
                out.append((name, len(units), body if body is None else "".join(stays + units[at:]), removed))
            made = pd.DataFrame(out, columns=["key", "n_units", "text", "removed"])
            yield made.assign(key=batch["key"].to_numpy())

    joined = rows.join(gone, "row", "left").select("key", "text", "gone")
    return joined.mapInPandas(clean, f"key {kind}, n_units int, text string, removed array<struct<start:long,end:long,units:int>>")
