"""Connected components of a table of links, as rounds of joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barweave.llm.common import Scratch


def components(links: DataFrame, room: Scratch, name: str = "components") -> DataFrame:
    """id, component (smallest id reached) for every end of a link (columns a, b).

    A round gives each node the smallest label among its neighbours' and then the label of its
    label, so long chains shorten by half. Each round is written, and the last but one dropped.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = room.save(both, f"{name}-links")
    labels = room.save(
        both.groupBy("a").agg(F.least("a", F.min("b")).alias("component")).withColumnRenamed("a", "id"), f"{name}-0"
    )
    step = 0
    while True:
        step += 1
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near.withColumnRenamed("a", "id"), "id").select(
            "id", F.col("component").alias("before"), F.least("component", "near").alias("low")
        )
        jump = labels.select(F.col("id").alias("low"), F.col("component").alias("next"))
        after = lower.join(jump, "low").select("id", "before", F.least("low", "next").alias("component"))
        written = room.save(after, f"{name}-{step}")
        moved = not written.where(F.col("before") != F.col("component")).isEmpty()
        room.drop(f"{name}-{step - 1}")
        labels = written.select("id", "component")
        if not moved:
            return labels
