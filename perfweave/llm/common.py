"""Helpers shared by the text operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space of the operators: the six ASCII characters, never Unicode's.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SHINGLE_WORDS = 5


def scratch(spark: SparkSession) -> str:
    """A fresh folder on the storage that the driver and all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/text-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Writes ``df`` to shared storage and reads it back.

    The result is computed once, its lineage is cut, and it outlives the executors that made it.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words_of(text: Column) -> Column:
    """Words of a text; an empty array for null, empty and blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bucket_count(rows: int, per_bucket: int = 500, most: int = 1 << 22) -> int:
    """A power of two, so that a bucket of uniform keys holds some ``per_bucket`` rows at any size."""
    n = 1
    while n < most and n * per_bucket < rows:
        n *= 2
    return n
