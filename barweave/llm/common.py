"""Helpers shared by the text operators."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.session import shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Texts reach Python in Arrow batches of so many rows, so that a batch of long ones stays small.
TEXTS_PER_BATCH = 1000


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character kept. Pure ASCII takes the faster built-in."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def small_batches(spark: SparkSession) -> None:
    """Bound the texts of one Arrow batch for the session; a smaller setting is kept."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXTS_PER_BATCH:
        spark.conf.set(key, str(TEXTS_PER_BATCH))


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of so many rows for the jobs inside, for narrow rows; their bytes stay bounded by the session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Scratch:
    """Tables of one run in a folder of their own below the shared folder.

    Executors can be lost at any time: what is read more than once is written here, by Spark's
    committing writer. `drop` removes a table when nothing reads it any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            remove(f"{self.folder}/{name}")


def remove(uri: str) -> None:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    if system.get_file_info(path).type != fs.FileType.NotFound:
        system.delete_dir(path)


@contextmanager
def scratch(spark: SparkSession, name: str):
    """A Scratch whose whole folder goes at the end, whatever happens."""
    room = Scratch(spark, name)
    try:
        yield room
    finally:
        remove(room.folder)
