"""Splitting rows into training and test parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A hash bucket is 1/65536 of the rows; the bucket table has that many rows per class.
BUCKET_SHIFT = 48


def row_hash(keys: list[str], seed: int | Column) -> Column:
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.xxhash64(*[F.col(k) for k in keys], seed)


def bucket_of(hashed: str) -> Column:
    """Ordered bucket of a 64-bit hash."""
    return F.shiftright(F.col(hashed), BUCKET_SHIFT)


def stratified_split(
    df: DataFrame, label: str, test_fraction: float, seed: int = 42, keys: tuple[str, ...] = ("symbol", "time")
) -> DataFrame:
    """Add `is_test`: exactly round(fraction * rows) rows of every class, the same on every run.

    The rows of a class with the smallest key hashes are the test part. Their number fixes one
    cut value per class, found from bucket counts and the rows of one bucket, so the rows
    themselves are not shuffled. The cut table has one row per class.
    """
    keys = list(keys)
    hashed = df.withColumn("_h", row_hash(keys, seed)).withColumn("_b", bucket_of("_h"))
    counts = hashed.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n"))
    ordered = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(label)
    wanted = F.round(F.sum("_n").over(everything) * F.lit(test_fraction)).cast("long")
    edges = (
        counts.select(
            label, "_b", "_n", F.coalesce(F.sum("_n").over(ordered), F.lit(0)).alias("_before"), wanted.alias("_want")
        )
        .where((F.col("_before") < F.col("_want")) & (F.col("_want") <= F.col("_before") + F.col("_n")))
        .select(label, "_b", (F.col("_want") - F.col("_before")).alias("_rank"))
    )
    place = F.struct("_h", *keys)
    in_edge = hashed.select(label, "_b", "_h", *keys).join(edges, [label, "_b"])
    cuts = (
        in_edge.withColumn("_i", F.row_number().over(Window.partitionBy(label, "_b").orderBy(place)))
        .where(F.col("_i") == F.col("_rank"))
        .select(label, place.alias("_cut"))
    )
    return (
        hashed.join(cuts, label, "left")
        .withColumn("is_test", F.coalesce(place <= F.col("_cut"), F.lit(False)))
        .drop("_h", "_b", "_cut")
    )


def ordered_split(df: DataFrame, test_fraction: float, bar_seconds: int) -> DataFrame:
    """Add `is_test`: the newest part of every symbol, so that no test bar precedes training."""
    from barweave.operators.blocks import number_rows

    numbered = df if "rn" in df.columns else number_rows(df, bar_seconds)
    sizes = numbered.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"))
    first_test = F.col("_n") - F.round(F.col("_n") * F.lit(test_fraction))
    joined = numbered.join(sizes, "symbol").withColumn("is_test", F.col("rn") >= first_test)
    return joined.drop("_n", *([] if "rn" in df.columns else ["rn"]))


def place_by_hash(df: DataFrame, hashed: str, groups: list[str], name: str) -> DataFrame:
    """Add `name`, the position from 0 of a row of its group in hash order."""
    bucketed = df.withColumn("_b", bucket_of(hashed))
    counts = bucketed.groupBy(*groups, "_b").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*groups, "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*groups, "_b").orderBy(hashed, "symbol", "time")
    return (
        bucketed.join(offsets, [*groups, "_b"])
        .withColumn(name, F.col("_off") + F.row_number().over(inside) - F.lit(1))
        .drop("_b", "_off")
    )
