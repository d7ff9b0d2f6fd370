"""How text filters interact: every order of applying them, step by step, per part of the corpus.

A document is reduced to a mask of the filters it fails, and the masks of a part are counted into
at most 2^filters cells. From there on the work no longer depends on the number of documents: a
recursive CTE extends prefixes of filters by each letter not used yet, carries the bits applied so
far, joins the part's cells and emits the metrics of that step. Orders are put together from the
prefixes that they share.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from barweave.llm.common import Scratch, small_batches

LETTERS = "ABCDE"
METRICS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
# Fixed values of the filters.
LEAST_WORDS = 50
LEAST_DISTINCT = 65  # percent of the words
MOST_UPPER = 5  # percent of the code points
SYMBOLS = b"#$%&*|"
UPPER = bytes(range(ord("A"), ord("Z") + 1))


def failed(text: str | None) -> int:
    """Bits of the filters A to D that a text fails; E depends on the other texts."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # at \x20 and \x09-\x0D, as bytes have it
    points = len(text or "")
    upper = len(raw) - len(raw.translate(None, UPPER))
    symbols = len(raw.translate(None, SYMBOLS)) < len(raw)
    few, same = len(words) < LEAST_WORDS, 100 * len(set(words)) < LEAST_DISTINCT * len(words)
    return few | same << 1 | (100 * upper > MOST_UPPER * points) << 2 | symbols << 3


@F.pandas_udf(IntegerType())
def failed_bits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([failed(t if isinstance(t, str) else None) for t in texts], dtype="int32")


def judged_rows(docs: DataFrame, labels: DataFrame, room: Scratch, key: str, text: str, part: str) -> DataFrame:
    """id, part, digest, mask (without E), good, toxic, n: input rows that agree in all of them, counted."""
    small_batches(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(body, 256)).alias("digest"), failed_bits(F.col(text)).alias("mask"),
    ).groupBy("id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    known = labels.groupBy(F.col(key).alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    joined = rows.join(known, "id", "left")
    return room.save(joined.fillna(False, ["good", "toxic"]), "judged")


def mask_cells(docs: DataFrame, labels: DataFrame, room: Scratch, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """part, cells: array of (mask, n, good, toxic), at most one entry per mask.

    A row fails E when a row with a smaller id has the same text. Such rows are the whole less the
    first ones: the smallest id of each text is found by a combining aggregate, and only rows with
    that very (text, id) are joined, so that a large group of copies never meets in one task.
    """
    rows = judged_rows(docs, labels, room, key, text, part)
    first = rows.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id")).alias("first")).select("digest", "first.id")
    same = rows["digest"].eqNullSafe(first["digest"]) & rows["id"].eqNullSafe(first["id"])
    sums = [F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic")]
    whole = rows.groupBy("part", "mask").agg(*sums)
    firsts = rows.join(first, same, "left_semi").groupBy("part", "mask").agg(*sums)
    again = F.lit(1 << LETTERS.index("E"))
    signed = (
        firsts.select("part", "mask", "n", "good", "toxic")
        .unionByName(whole.withColumn("mask", F.col("mask").bitwiseOR(again)))
        .unionByName(firsts.select("part", F.col("mask").bitwiseOR(again).alias("mask"), (-F.col("n")).alias("n"), (-F.col("good")).alias("good"), (-F.col("toxic")).alias("toxic")))
    )
    counted = signed.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    cells = counted.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("mask", "n", "good", "toxic"))).alias("cells"))
    return room.save(cells, "cells")


def _total(of: str, condition: str) -> str:
    return f"aggregate(c.cells, 0L, (s, x) -> s + IF({condition}, x.{of}, 0L))"


def order_steps(cells: DataFrame, room: Scratch, letters: str = LETTERS) -> DataFrame:
    """part, prefix, step and METRICS for every sequence of different filters; the last letter is the step's filter."""
    here = "x.mask & p.applied = 0 AND x.mask & f.bit != 0"
    choices = ", ".join(f"named_struct('letter', '{letter}', 'bit', {1 << i})" for i, letter in enumerate(letters))
    statement = f"""
WITH RECURSIVE prefixes(part, prefix, applied, step, {', '.join(METRICS)}) AS (
  SELECT part, '', 0, 0, {', '.join(['0L'] * len(METRICS))} FROM {{cells}}
  UNION ALL
  SELECT p.part, p.prefix || f.letter, p.applied | f.bit, p.step + 1,
    {_total('n', 'x.mask & (p.applied | f.bit) = 0')}, {_total('n', here)},
    {_total('n', 'x.mask & p.applied != 0 AND x.mask & f.bit != 0')}, {_total('n', 'x.mask = f.bit')},
    {_total('good', here)}, {_total('toxic', here)}
  FROM prefixes p JOIN {{cells}} c ON c.part = p.part
  LATERAL VIEW inline(filter(array({choices}), l -> l.bit & p.applied = 0)) f
)
SELECT part, prefix, step, {', '.join(METRICS)} FROM prefixes WHERE step > 0"""
    spark = cells.sparkSession
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")  # the rows are the parts times a constant
    try:
        return room.save(spark.sql(statement, cells=cells), "steps")
    finally:
        spark.conf.set(limit, before)


def filter_orders(docs: DataFrame, labels: DataFrame, room: Scratch, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row per part, filter_order (all 120 of ABCDE) and step: the METRICS and shapley.

    shapley sums what the step's filter removes over all orders. Null and empty texts have no
    words; a null part is the empty string. A null id is larger than any other and equal to other
    nulls: rows of the smallest id that repeat a text all pass E. An id that has several labels is
    good or toxic if one of them says so; null labels say nothing. An empty table gives no rows;
    other columns are not read.
    """
    steps = order_steps(mask_cells(docs, labels, room, key, text, part), room)
    n = len(LETTERS)
    ways = F.element_at(F.array(*[F.lit(factorial(n - s)) for s in range(1, n + 1)]), F.col("step"))
    fair = steps.groupBy("part", F.right("prefix", F.lit(1)).alias("filter")).agg(F.sum(F.col("removed") * ways).alias("shapley"))
    orders = steps.where(F.col("step") == n).select("part", F.col("prefix").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    orders = orders.withColumn("prefix", _start(F.col("filter_order"), F.col("step"))).withColumn("filter", F.right("prefix", F.lit(1)))
    return orders.join(steps.drop("step"), ["part", "prefix"]).join(fair, ["part", "filter"]).select("part", "filter_order", "step", *METRICS, "shapley")


def _start(text: Column, n: Column) -> Column:
    return F.substring(text, F.lit(1), n)
