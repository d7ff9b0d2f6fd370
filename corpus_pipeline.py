"""From raw documents to packed training sequences, in five stages over the whole table.

Every stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and
read back as the next one's `docs`. All but the last return the columns of documents, whatever
their names are. Null texts count as empty; null and repeated ids are documents of their own; an
empty table passes through every stage.
"""

from __future__ import annotations

import uuid
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.llm import decontaminate, exact_dedup, jaccard, quality
from barweave.llm.common import Scratch, small_batches
from barweave.llm.queries import packed_pieces, quality_model, settled, table

NEAR_WORDS = 5
NEAR_SIMILARITY = Fraction(8, 10)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score of one half or more)."""
    small_batches(spark)
    score = quality.score_udf(quality_model(docs, table(spark, sf_dir, "labels")))
    return docs.where(score(F.col("text")) >= 0.5)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact_copies(docs, Scratch(spark, "exact"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similarity links hold together: that with the smallest id, null being the largest.

    Rows are told apart by their number, so null and repeated ids are documents of their own.
    """
    room, row = Scratch(spark, "near"), f"_row_{uuid.uuid4().hex}"
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    found, _ = jaccard.linked_documents(numbered, room, NEAR_WORDS, NEAR_SIMILARITY, key=row)
    named = found.select(F.col("key").alias(row), "component").join(numbered.select(row, "doc_id"), row)
    first = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", row))[row].alias(row))
    return numbered.join(settled(first.select(row), room), row, "left_semi").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a notable share of benchmark windows."""
    small_batches(spark)
    held = docs.select(F.struct("*").alias("document"), "text")
    judged = decontaminate.contamination(held, table(spark, sf_dir, "benchmark"))
    return judged.where(~decontaminate.is_contaminated()).select("document.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 1024 tokens."""
    return packed_pieces(spark, docs)


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

# A learned model, set similarity over components and subword ids cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, room = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = room.save(stage(spark, docs, sf_dir), name)
    return docs
