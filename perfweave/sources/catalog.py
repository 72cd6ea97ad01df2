"""Which log files there are, and what their names say about them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perfweave.config import EngineConfig


def _claims(source: Column, name: Column) -> Column:
    """Whether file ``name`` is a log of ``source`` at all."""
    return (
        name.startswith(source)
        & name.endswith(".log")
        & (
            (name == F.concat(source, F.lit(".log")))
            | name.contains("_slow")
            | name.startswith(F.concat(source, F.lit("_")))
            | name.startswith(F.concat(source, F.lit("-")))
        )
    )


def classify_files(files: DataFrame, config: EngineConfig, name_col: str = "file_key") -> DataFrame:
    """Adds source, type, severity and is_rolling from the file name; drops other files.

    The first configured source that claims a name gets it. Sources are a short configured
    list, looked up inside the row: no join.
    """
    name, source = F.col(name_col), F.col("source")

    def named(tail: str) -> Column:
        return name == F.concat(source, F.lit(tail))

    known = F.array(*[F.lit(s) for s in config.sources])
    type_ = (
        F.when(named("_very_slow.log"), "very_slow")
        .when(named("_slow.log"), "slow")
        .when(named(".log"), "cpu")
        .when(name.contains("_very_slow"), "very_slow")
        .when(name.contains("_slow"), "slow")
        .otherwise("cpu")
    )
    rolling = named(".log") | named("_slow.log") | named("_very_slow.log")
    return (
        files.withColumn("source", F.get(F.filter(known, lambda s: _claims(s, name)), F.lit(0)))
        .filter("source IS NOT NULL")
        .withColumn("type", type_)
        .withColumn("severity", F.when(F.col("type") != "cpu", F.col("type")))
        .withColumn("is_rolling", rolling)
    )


def list_logs(spark: SparkSession, data_dir: str, config: EngineConfig) -> DataFrame:
    """One row per log file directly inside ``data_dir``. File contents are not read:
    the scan's ReadSchema holds path, length and modification time only."""
    listing = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.log")
        .load(data_dir)
        .select(
            F.element_at(F.split("path", "/"), -1).alias("file_key"),
            "path",
            F.col("length").alias("file_size"),
            F.unix_seconds("modificationTime").alias("file_mtime"),
        )
    )
    return classify_files(listing, config)


def total_log_bytes(files: DataFrame) -> DataFrame:
    return files.agg(F.coalesce(F.sum("file_size"), F.lit(0)).cast("bigint").alias("total_bytes"))


def pending_bytes(plan: DataFrame) -> DataFrame:
    """Bytes an import would read, over the output of ``operators.resume.resume_plan``."""
    todo = reduce(lambda a, b: a | b, [F.col("action") == a for a in ("replaced", "append", "seek", "full")])
    left = F.when(todo, F.col("file_size") - F.col("start_offset")).otherwise(0)
    return plan.agg(F.coalesce(F.sum(left), F.lit(0)).cast("bigint").alias("pending_bytes"))
