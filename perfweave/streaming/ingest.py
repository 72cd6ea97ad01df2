"""Continuous import: tailed records go through the same accept-and-store step as a batch."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from perfweave.config import DEFAULT_CONFIG, EngineConfig
from perfweave.operators.parse_cpu import parse_blocks
from perfweave.operators.parse_slow import parse_slow
from perfweave.plans.ingest import keep_cpu_columns, keep_slow_columns, load_rows
from perfweave.plans.store import Store, delete, run_together, shuffles_removed, stage
from perfweave.sources.tail import planned_position, tail_logs


def store_batch(
    records: DataFrame, batch_id: int, store: Store, query: str, now: int, config: EngineConfig
) -> None:
    """Stores one micro-batch of raw records as a run. A repeated batch is recognised and skipped."""
    mark = f"stream:{query}:{batch_id}"
    if store.has_mark(mark):
        return
    scratch = store.scratch()
    try:
        # A batch belongs to a session of the stream's own.
        with shuffles_removed(store.spark), shuffles_removed(records.sparkSession):
            _store(records, store, scratch, mark, now, config)
    finally:
        delete(store.spark, scratch)


def _store(records: DataFrame, store: Store, scratch: str, mark: str, now: int, config: EngineConfig) -> None:
    raw = stage(records, f"{scratch}/raw")
    if raw.isEmpty():
        return

    def of(kind: str) -> DataFrame:
        return raw.filter(kind).drop("type", "is_rolling")

    slow, cpu = run_together([
        lambda: stage(keep_slow_columns(parse_slow(of("type <> 'cpu'"), "record", config.log_tz)), f"{scratch}/slow"),
        lambda: stage(keep_cpu_columns(parse_blocks(of("type = 'cpu'"), "record", config.log_tz)), f"{scratch}/cpu"),
    ])
    files = stage(raw.select("file_key", "source").distinct(), f"{scratch}/files")
    # The text has been parsed; what is stored comes from the rows.
    delete(store.spark, f"{scratch}/raw")
    # Positions live in the stream's checkpoint, so the batch import's state has nothing to add.
    load_rows(store, slow, cpu, files.withColumn("action", F.lit("stream")), None, scratch, now, config, [mark])


def tail_into_store(
    spark: SparkSession,
    data_dir: str,
    store: Store,
    checkpoint: str,
    clock: Callable[[], int],
    config: EngineConfig = DEFAULT_CONFIG,
    finalize: bool = False,
    max_bytes: int = 0,
    query: str = "tail",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Starts importing what is appended under ``data_dir``.

    By default it takes what is there and stops; pass ``trigger`` for a running import.
    ``clock`` gives the time that import window and duplicate horizon count from. ``max_bytes`` limits
    each batch; with ``availableNow`` steps of that size follow each other until nothing is left, and the
    query returned is the last of them.
    """
    trigger = trigger or {"availableNow": True}
    in_steps = bool(max_bytes and trigger.keys() & {"availableNow", "once"})

    def mark() -> str:
        # The id that a checkpoint keeps over restarts: another checkpoint counts its own batches.
        return f"{query}:{json.loads(spark.read.text(f'{checkpoint}/metadata').first()[0])['id']}"

    def start() -> StreamingQuery:
        stream = tail_logs(spark, data_dir, config, finalize, config.import_cutoff(clock()), max_bytes, checkpoint)
        return (
            stream.writeStream.foreachBatch(
                lambda df, batch_id: store_batch(df, batch_id, store, mark(), clock(), config)
            )
            .option("checkpointLocation", checkpoint)
            .trigger(**trigger)
            .start()
        )

    query_ = start()
    while in_steps:
        query_.awaitTermination()
        before, query_ = planned_position(checkpoint), start()
        query_.awaitTermination()
        in_steps = planned_position(checkpoint) != before
    return query_
