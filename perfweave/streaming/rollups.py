"""Rollups kept current by watermarked streams, and de-duplication within a horizon.

Input streams have an ``event_time`` timestamp. A bucket is emitted once, when the watermark
has passed its end; state is one row per open bucket and key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perfweave.operators.dedup import split_fresh


def with_event_time(rows: DataFrame, ts: str) -> DataFrame:
    return rows.withColumn("event_time", F.timestamp_seconds(ts))


def _tumbling(rows: DataFrame, delay: str, width: str, keys: Sequence[str], measures: list[Column]) -> DataFrame:
    return (
        rows.withWatermark("event_time", delay)
        .groupBy(F.window("event_time", width).alias("_w"), *keys)
        .agg(*measures)
        .withColumn("bucket_time", F.unix_seconds("_w.start"))
        .drop("_w")
    )


def _slow_measures() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("event_count"),
        F.min("execution_ms").alias("min_execution_ms"),
        F.max("execution_ms").alias("max_execution_ms"),
        F.sum("execution_ms").alias("sum_execution_ms"),
    ]


def slow_overview_stream(events: DataFrame, delay: str = "7 days") -> DataFrame:
    """Slow events per source and 30 s."""
    return _tumbling(events, delay, "30 seconds", ["source"], _slow_measures())


def slow_function_stream(events: DataFrame, delay: str = "7 days") -> DataFrame:
    """Slow events per source, hour and function."""
    return _tumbling(events, delay, "1 hour", ["source", "description_id"], _slow_measures())


def cpu_overview_stream(reports: DataFrame, delay: str = "7 days") -> DataFrame:
    """Header metrics per source and 30 s."""
    return _tumbling(reports, delay, "30 seconds", ["source"], [
        F.avg("cpu_usage").alias("avg_cpu_usage"),
        F.avg("players_online").alias("avg_players_online"),
        F.count(F.lit(1)).alias("sample_count"),
    ])


def cpu_function_stream(stats: DataFrame, delay: str = "7 days") -> DataFrame:
    """Statistics per source, hour and function; input carries source and event_time."""
    return _tumbling(stats, delay, "1 hour", ["source", "description_id"], [
        F.max("real_usage").alias("max_real_usage"),
        F.sum("real_usage").alias("sum_real_usage"),
        F.sum("time_ms").alias("sum_time_ms"),
        F.sum("calls").alias("sum_calls"),
        F.count(F.lit(1)).alias("sample_count"),
    ])


def _hashes(rows: DataFrame, key: Sequence[str]) -> list[Column]:
    """Two 64-bit hashes of a key, nulls told apart from values."""
    parts = [*[F.col(c) for c in key], *[F.isnull(c) for c in key]]
    return [F.xxhash64(F.lit(seed), *parts).alias(f"_h{seed}") for seed in (1, 2)]


def dedup_stream(rows: DataFrame, key: Sequence[str], horizon: str = "7 days") -> DataFrame:
    """First row per key; later copies are dropped, and rows older than the horizon are too.

    State is two hashes and a time per key, whatever the key holds; with 10^10 keys at a time any two have
    the same hashes with a chance of 10^-19. Stricter than the batch rule: rows past the high-water mark
    are not exempt, as they are in ``dedup_fresh_stream``.
    """
    hashed = rows.select("*", *_hashes(rows, key)).withWatermark("event_time", horizon)
    return hashed.dropDuplicatesWithinWatermark(["_h1", "_h2"]).select(*rows.columns)


def dedup_fresh_stream(
    rows: DataFrame, marks: DataFrame, key: Sequence[str], ts: str, by: Sequence[str], horizon: str = "7 days"
) -> DataFrame:
    """The batch rule on a stream: rows past the mark of their stream are kept as they are, repeats too.

    Of the others one row per key is kept. ``marks`` (``by``, max_ts) are the high-water marks of what was
    stored before the stream; streams without one are checked. State holds the checked keys alone. Rows
    stored before the stream are known to ``marks`` only, so a batch import has to be complete up to them.
    """
    fresh, rest = split_fresh(rows, marks, ts, by)
    return fresh.unionByName(dedup_stream(rest, key, horizon))


# Where the state of long horizons belongs: on the executors' disks, with changes in the checkpoint.
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB; a query's checkpoint remembers it."""
    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
