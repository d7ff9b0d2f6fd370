"""Cutting long series into blocks of bounded size.

One symbol may hold a third of all rows, so no window here is partitioned by the symbol alone.
`number_rows` gives every row its position inside its symbol, `lay_out` deals the rows to
blocks of `block_rows` rows (with copies of the neighbours a window looks at), and
`prefix` carries sums and maxima from block to block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_BUCKET = 4096
BLOCKS_PER_GROUP = 4096


def time_bucket(time: str, bar_seconds: int, rows: int = ROWS_PER_BUCKET) -> Column:
    """Bucket of a bar start; holds at most `rows` bars of a symbol as (symbol, time) is unique."""
    return F.floor(F.unix_timestamp(time) / F.lit(bar_seconds * rows)).cast("long")


def _bucket_offsets(bucketed: DataFrame, newest_first: bool) -> DataFrame:
    """symbol, _tb and _off, the number of rows in the symbol's buckets that come earlier in the order."""
    counts = bucketed.groupBy("symbol", "_tb").agg(F.count(F.lit(1)).alias("_n"))
    order = F.col("_tb").desc() if newest_first else F.col("_tb").asc()
    earlier = Window.partitionBy("symbol").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("symbol", "_tb", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).cast("long").alias("_off"))


def _ranked(bucketed: DataFrame, offsets: DataFrame, newest_first: bool) -> DataFrame:
    """Add `rn`; rows of one symbol and time follow the values of their other columns."""
    others = [f"`{f.name}`" for f in bucketed.schema if f.name not in ("symbol", "time", "_tb") and _orderable(f.dataType)]
    keys = [F.col("time"), *[F.col(c) for c in others]]
    inside = Window.partitionBy("symbol", "_tb").orderBy(*[k.desc() if newest_first else k.asc() for k in keys])
    return (
        bucketed.join(offsets, ["symbol", "_tb"])
        .withColumn("rn", F.col("_off") + F.row_number().over(inside) - F.lit(1))
        .drop("_tb", "_off")
    )


def _orderable(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))


def number_rows(
    bars: DataFrame, bar_seconds: int, rows_per_bucket: int = ROWS_PER_BUCKET, newest_first: bool = False
) -> DataFrame:
    """Add `rn`, the position from 0 of a row inside its symbol, in time order.

    Rows are ranked inside time buckets; the counts of the earlier buckets, a table of one row
    per bucket, give the offset. `bar_seconds` is the bar length.
    """
    bucketed = bars.withColumn("_tb", time_bucket("time", bar_seconds, rows_per_bucket))
    return _ranked(bucketed, _bucket_offsets(bucketed, newest_first), newest_first)


def last_rows(bars: DataFrame, n: int, bar_seconds: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """The newest n rows of every symbol.

    The counts of the buckets tell which ones can hold such rows; only these are ranked. The oldest
    of them also bounds the time in the scan, as a subquery, so older files and row groups are skipped.
    """
    bucketed = bars.withColumn("_tb", time_bucket("time", bar_seconds, rows_per_bucket))
    offsets = _bucket_offsets(bucketed, newest_first=True).where(F.col("_off") < n)
    first = F.timestamp_seconds(F.min("_tb") * F.lit(bar_seconds * rows_per_bucket))
    recent = bucketed.where(F.col("time") >= offsets.select(first.alias("first")).scalar())
    return _ranked(recent, offsets, newest_first=True).where(F.col("rn") < n).drop("rn")


def lay_out(numbered: DataFrame, block_rows: int, back: int = 0, ahead: int = 0) -> DataFrame:
    """Add `blk`; a block also receives the `back` rows before and the `ahead` rows after it."""
    if back > block_rows or ahead > block_rows:
        raise ValueError(f"a block of {block_rows} rows cannot look {max(back, ahead)} rows away")
    home = F.floor(F.col("rn") / F.lit(block_rows)).cast("long")
    place = F.col("rn") % F.lit(block_rows)
    if not back and not ahead:
        return numbered.withColumn("blk", home).repartition("symbol", "blk")
    none = F.lit(None).cast("long")
    targets = [home]
    if back:
        targets.append(F.when(place >= block_rows - back, home + 1).otherwise(none))
    if ahead:
        targets.append(F.when((place < ahead) & (home > 0), home - 1).otherwise(none))
    return numbered.withColumn("blk", F.explode(F.array_compact(F.array(*targets)))).repartition(
        "symbol", "blk"
    )


def own_row(block_rows: int) -> Column:
    """True for the rows a block answers for, false for copied neighbours."""
    return F.floor(F.col("rn") / F.lit(block_rows)).cast("long") == F.col("blk")


def prefix(
    blocks: DataFrame, sums: list[str] = (), maxes: list[str] = (), size: int = BLOCKS_PER_GROUP
) -> DataFrame:
    """For every (symbol, blk): sum and max of the columns over all earlier blocks.

    Two levels: inside groups of `size` blocks, and over the group totals, so that no task sees
    more than rows / (block_rows * size) group rows of a symbol. NULL where nothing came before.
    """
    grouped = blocks.withColumn("_grp", F.floor(F.col("blk") / F.lit(size)).cast("long"))
    totals = grouped.groupBy("symbol", "_grp").agg(
        *[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in maxes]
    )
    over_groups = Window.partitionBy("symbol").orderBy("_grp").rowsBetween(Window.unboundedPreceding, -1)
    over_blocks = Window.partitionBy("symbol", "_grp").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(
        "symbol",
        "_grp",
        *[F.sum(c).over(over_groups).alias(f"_b_{c}") for c in sums],
        *[F.max(c).over(over_groups).alias(f"_b_{c}") for c in maxes],
    )

    def both(c: str, how) -> Column:
        inner = how(c).over(over_blocks)
        return F.coalesce(F.col(f"_b_{c}") + inner, inner, F.col(f"_b_{c}"))

    def greater(c: str) -> Column:
        return F.greatest(F.col(f"_b_{c}"), F.max(c).over(over_blocks))

    return grouped.join(base, ["symbol", "_grp"]).select(
        "symbol", "blk", *[both(c, F.sum).alias(c) for c in sums], *[greater(c).alias(c) for c in maxes]
    )
