"""Exact duplicates of normalised text, safe against very large groups of copies.

Rows are first combined inside each input partition, then per (digest, content, salt), where the
salt follows the input partition, and then over the salts. The content is part of the grouping
key in all three steps, so rows are only ever joined when their whole texts are equal; the digest
spares comparisons and moves the result. One large group costs a task at most one row per input
partition (of its salt).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barweave.llm.common import Scratch, ascii_lower

SALTS = 16


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def exact_groups(
    docs: DataFrame, room: Scratch, key: str = "doc_id", text: str = "text",
    normalise: Callable[[Column], Column] = ascii_lower, digest: Callable[[Column], Column] = sha256, carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: key, digest, the columns of `carry`, keep (largest key of the group), group_size, kept.

    Null text counts as empty. Of equal texts the row with the largest key stays; a null key is
    the smallest. Rows that repeat key and text are all marked kept if their key is; they count
    in group_size. An empty table gives an empty result; other columns are not read.
    Texts with equal digests but different contents are told apart by content.
    """
    rows = docs.select(
        F.col(key).alias("key"), normalise(F.coalesce(F.col(text), F.lit(""))).alias("content"), *carry
    ).withColumn("digest", digest(F.col("content")))
    salt = F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt")
    salted = (
        rows.select("digest", "content", salt, "key")
        .groupBy("digest", "content", "salt")
        .agg(F.max("key").alias("keep"), F.count(F.lit(1)).alias("n"))
    )
    groups = salted.groupBy("digest", "content").agg(F.max("keep").alias("keep"), F.sum("n").alias("n"))
    by_digest = room.save(
        groups.groupBy("digest").agg(
            F.max("keep").alias("keep"), F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("contents")
        ),
        "groups",
    )
    single = by_digest.where(F.col("contents") == 1).drop("contents")
    found = rows.select("key", "digest", *carry).join(single, "digest")
    shared = by_digest.where(F.col("contents") > 1).select("digest")
    if not shared.isEmpty():  # digests that several contents share: join by the content itself
        apart = groups.join(shared, "digest", "left_semi").withColumnRenamed("n", "group_size")
        again = rows.join(apart, ["digest", "content"]).select("key", "digest", *carry, "keep", "group_size")
        found = found.unionByName(again)
    return found.withColumn("kept", F.col("key").eqNullSafe(F.col("keep")))


def drop_exact_copies(docs: DataFrame, room: Scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of `docs` for each text, with its own columns: that of the largest key, null being the smallest.

    Of rows that repeat key and text one stays. `docs` is read more than once and has to be a stored
    table; rows are told apart by their number in it.
    """
    row = f"_row_{uuid.uuid4().hex}"
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    kept = exact_groups(numbered, room, key, text, carry=(row,)).where("kept").groupBy("digest", "key").agg(F.min(row).alias(row))
    return numbered.join(kept.select(row), row, "left_semi").select(*docs.columns)
