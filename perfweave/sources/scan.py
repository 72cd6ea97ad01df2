"""Whole-file line scan with Spark's own text reader (no Python, splittable)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of every ``.log`` file under ``path``: file_key, blk, line.

    Only a line feed ends a line; the reader's default would also split on a lone carriage
    return. ``line`` keeps the raw bytes. ``blk`` is the start of the file split.
    """
    return (
        spark.read.option("lineSep", "\n")
        .option("pathGlobFilter", "*.log")
        .text(path)
        .select(
            F.col("_metadata.file_name").alias("file_key"),
            F.col("_metadata.file_block_start").alias("blk"),
            F.col("value").cast("binary").alias("line"),
        )
    )
