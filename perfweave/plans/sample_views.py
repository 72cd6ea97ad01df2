"""The driver's star-schema tables seen as log facts, and written out as log files.

``events`` become slow events, ``orders`` report headers, ``lineitem`` report statistics and
``part`` the names of functions. The mapping is plain column arithmetic, so a SQL engine can
repeat it and check every query.
"""

from __future__ import annotations

import sys
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfweave.config import BUCKET_SECONDS, RANGE_SECONDS, EngineConfig
from perfweave.functions.time import epoch_date
from perfweave.operators.rollups import all_rollups, slow_function, slow_overview
from perfweave.plans.store import delete, shuffles_removed, stage
from perfweave.tables import LogTables

cloudpickle.register_pickle_by_value(sys.modules[__name__])

EVENT_SOURCES = ("click", "error", "purchase", "signup", "view")
ORDER_SOURCES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")

# The orders span years: "all" covers them whole.
VIEW_RANGES = {**RANGE_SECONDS, "all": 4000 * 86400}
VIEW_BUCKETS = {**BUCKET_SECONDS, "all": 86400}
SLOW_CONFIG = EngineConfig(
    sources=EVENT_SOURCES, header_source="click", ranges=VIEW_RANGES, buckets=VIEW_BUCKETS
)
CPU_CONFIG = EngineConfig(
    sources=ORDER_SOURCES, header_source="1-URGENT", ranges=VIEW_RANGES, buckets=VIEW_BUCKETS
)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _epoch(ts: str):
    """Whole seconds of a zoneless timestamp taken as UTC, whatever the session time zone."""
    return F.expr(
        f"unix_date(cast({ts} as date)) * 86400L + hour({ts}) * 3600 + minute({ts}) * 60 + second({ts})"
    )


def slow_view(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_type").alias("source"),
        F.when(F.col("value") >= 100, "very_slow").otherwise("slow").alias("severity"),
        _epoch("ts").alias("occurred_at"),
        F.floor(F.col("value") * 10).cast("bigint").alias("execution_ms"),
        (F.col("user_id") + 1).alias("description_id"),
        F.concat(F.lit("fn_"), F.col("user_id")).alias("description"),
        F.col("props").alias("detail"),
    )


def report_view(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    return orders.select(
        key.alias("report_id"),
        F.col("o_orderpriority").alias("source"),
        (_epoch("o_orderdate") + (key * 37) % 86400).alias("reported_at"),
        F.when(key % 11 != 0, F.col("o_totalprice") % 100).alias("cpu_usage"),
        (F.col("o_custkey") % 1000).alias("players_online"),
    )


def stat_view(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        F.col("l_orderkey").alias("report_id"),
        (F.col("l_partkey") + 1).alias("description_id"),
        F.col("l_quantity").cast("bigint").alias("time_ms"),
        F.col("l_linenumber").cast("bigint").alias("calls"),
        (F.col("l_discount") * 100).alias("rel_usage"),
        (F.col("l_tax") * 100).alias("real_usage"),
    )


def slow_names(events: DataFrame) -> DataFrame:
    return slow_view(events).groupBy("description_id").agg(
        F.min("source").alias("source"), F.min("description").alias("description")
    )


def part_names(part: DataFrame) -> DataFrame:
    return part.select(
        (F.col("p_partkey") + 1).alias("description_id"),
        F.lit(ORDER_SOURCES[0]).alias("source"),
        F.concat("p_name", F.lit("#"), F.col("p_partkey")).alias("description"),
    )


def slow_tables(spark: SparkSession, sf_dir: str, with_rollups: bool = False) -> LogTables:
    events = read(spark, sf_dir, "events")
    facts = slow_view(events)
    if not with_rollups:
        return LogTables(slow_names(events), slow_events=facts)
    return LogTables(
        slow_names(events),
        slow_events=facts,
        slow_overview_agg=slow_overview(facts),
        slow_function_bucket_agg=slow_function(facts),
    )


def cpu_tables(spark: SparkSession, sf_dir: str, with_rollups: bool = False) -> LogTables:
    reports = report_view(read(spark, sf_dir, "orders"))
    stats = stat_view(read(spark, sf_dir, "lineitem"))
    names = part_names(read(spark, sf_dir, "part"))
    rollups = {}
    if with_rollups:
        frames = all_rollups(reports, stats, slow_view(read(spark, sf_dir, "events")))
        rollups = {n: df for n, df in frames.items() if n.startswith("cpu_")}
    return LogTables(names, cpu_reports=reports, cpu_stats=stats, **rollups)


# Log text

TEXT_SOURCES = ("urgent", "high", "medium", "unspecified", "low")
TEXT_START = 1_704_067_200  # 1 January 2024
TEXT_CONFIG = EngineConfig(
    sources=(*EVENT_SOURCES, *TEXT_SOURCES), header_source="urgent", import_days=0, range_bytes=4 << 20
)


def _stamp(ts: str):
    day = epoch_date(F.col(ts))
    second = F.col(ts) % 86400
    return F.format_string(
        "[%d/%d/%d %d:%d:%d]", F.day(day), F.month(day), F.year(day),
        F.expr(f"{ts} % 86400 div 3600"), F.expr(f"{ts} % 3600 div 60"), second % 60,
    )


def _padded(value, width: int):
    """As ``%<width>s`` puts it, many times faster than ``format_string``."""
    text = F.coalesce(value.cast("string"), F.lit("null"))
    return F.when(F.length(text) < width, F.lpad(text, width, " ")).otherwise(text)


def _five_places(value):
    """As ``%.5f`` puts it; what a decimal would show otherwise (signs of zero, no numbers) is left to that."""
    exact = F.when(value > 0, value.try_cast("decimal(18,5)").cast("string"))
    return F.coalesce(exact, F.format_string("%.5f", value))


def slow_text(events: DataFrame) -> DataFrame:
    """(file_name, at, id, text): one slow-event line per event.

    By key: long names keep their description, short ones are replaced by the detail; some
    lines end in CRLF, some are followed by a blank or a junk line.
    """
    user = F.col("user_id")
    name = F.when(user % 3 == 0, F.concat(F.lit("task(a - "), user, F.lit(", queue)"))).otherwise(
        F.concat(F.lit("fn_"), user)
    )
    rows = events.select(
        "event_id", name.alias("name"),
        F.col("event_type").alias("source"),
        F.when(F.col("value") >= 100, "very_slow").otherwise("slow").alias("severity"),
        _epoch("ts").alias("at"),
        F.floor(F.col("value") * 10).cast("bigint").alias("ms"),
        F.col("props").alias("detail"),
    )
    line = F.concat(
        _stamp("at"), F.lit(" Execution time: "), F.col("ms"), F.lit(" ms - "), F.col("name"),
        F.lit(" - "), F.col("detail"), F.when(F.col("event_id") % 5 == 0, "\r\n").otherwise("\n"),
        F.when(F.col("event_id") % 7 == 0, "\n").when(F.col("event_id") % 7 == 1, "server restarted\n").otherwise(""),
    )
    return rows.select(
        F.concat("source", F.lit("_"), "severity", F.lit(".log")).alias("file_name"),
        "at", F.col("event_id").alias("id"), line.alias("text"),
    )


def report_text(orders: DataFrame, lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """(file_name, at, id, text): one report block per order with its line items.

    Reports are spread over the 30 days the events cover, in a file per source and week.
    By key: some names go on over further lines (one of them beginning with a bracket), with a
    blank line in between; reports without a CPU figure have no header metrics.
    """
    names = part.select(F.col("p_partkey").alias("l_partkey"), F.concat("p_name", F.lit("#"), F.col("p_partkey")).alias("name"))
    more = F.when(F.col("l_partkey") % 5 == 0, "\n\n[local\n\tfunction run()").otherwise("")
    stat = F.concat(
        _padded(F.col("l_quantity").cast("bigint"), 10), _padded(F.col("l_linenumber").cast("bigint"), 10),
        _padded(_five_places(F.col("l_discount") * 100), 15), F.lit("%"),
        _padded(_five_places(F.col("l_tax") * 100), 15), F.lit("% "),
        _padded(F.col("name"), 0), more, F.lit("\n"),
    )
    # The names grow with the data: a broadcast of them would be held by the driver. Lines are brought together
    # before they are collected, as hardly any two lines of a report meet in a task of the join.
    stats = lineitem.join(names.hint("merge"), "l_partkey").select(
        F.col("l_orderkey").alias("report_id"), stat.alias("line")
    ).repartition("report_id")
    at = F.lit(TEXT_START) + (F.col("report_id") * 7919) % (30 * 86400)
    reports = report_view(orders).withColumn("reported_at", at.cast("bigint"))
    body = stats.groupBy("report_id").agg(F.array_join(F.array_sort(F.collect_list("line")), "").alias("body"))
    source = F.element_at(
        F.create_map(*[F.lit(x) for pair in zip(ORDER_SOURCES, TEXT_SOURCES) for x in pair]), F.col("source")
    )
    head = F.when(
        F.col("cpu_usage").isNotNull(),
        F.format_string(
            "Thread: 1 Cpu usage: %.5f%% Idle: %.5f%% Other: -0.5%% Players online: %d\n",
            F.col("cpu_usage"), 100 - F.col("cpu_usage"), F.col("players_online"),
        ),
    ).otherwise("")
    text = F.concat(
        _stamp("reported_at"), F.lit("\n"), head,
        F.lit(" Time (ms)     Calls     Rel usage %    Real usage % Description\n"), F.coalesce("body", F.lit("")), F.lit("\n"),
    )
    week = F.expr(f"(reported_at - {TEXT_START}) div 604800").cast("string")
    return reports.join(body, "report_id", "left").select(
        F.concat(source, F.lit("-w"), week, F.lit(".log")).alias("file_name"),
        F.col("reported_at").alias("at"), F.col("report_id").alias("id"), text.alias("text"),
    )


PIECE_SECONDS = 86400
PIECE_CODEC = "zstd"


def pieces_folder(folder: str) -> str:
    """Where ``write_files`` puts the pieces of the files in ``folder``."""
    return f"{folder.rstrip('/')}.pieces"


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Writes (file_name, at, id, text) rows as named files, each in time order.

    A file is one object and has one writer, so rows are sorted and written in pieces of a day first, many at a
    time; a file's writer only copies bytes. The pieces stay in ``pieces_folder``, compressed, and what was
    shuffled to sort them is gone before the files are begun: together they would take the disk of the logs three times.
    Returns (file_name, rows), to be run by an action.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ("file_name", "piece", "at", "id")
    spread = rows.withColumn("piece", F.expr(f"at div {PIECE_SECONDS}")).repartition(n, "file_name", "piece").sortWithinPartitions(*order)
    kept = pieces_folder(folder)

    def write(batches):
        import pyarrow.fs as pafs

        fs, base = pafs.FileSystem.from_uri(kept)
        fs.create_dir(base, recursive=True)
        current, out, n = None, None, 0

        def closed():
            out.close()
            return pa.RecordBatch.from_pydict(
                {"file_name": [current[0]], "piece": pa.array([current[1]], pa.int64()), "rows": [n]}
            )

        for batch in batches:
            text, i = batch["text"], 0
            if text.null_count:
                raise ValueError("a record without text")
            _, ends, data = text.buffers()
            at = np.frombuffer(ends, np.int32, len(text) + 1, text.offset * 4).tolist()
            for key, same in groupby(zip(batch["file_name"].to_pylist(), batch["piece"].to_pylist())):
                if key != current:
                    if out is not None:
                        yield closed()
                    current, n = key, 0
                    out = fs.open_output_stream(f"{base}/{key[0]}.{key[1]}", compression=PIECE_CODEC)
                j = i + sum(1 for _ in same)
                # Records that follow each other lie so in the batch.
                if at[j] > at[i]:
                    out.write(data.slice(at[i], at[j] - at[i]))
                n, i = n + j - i, j
        if out is not None:
            yield closed()

    def join(batches):
        import shutil

        import pyarrow.fs as pafs

        (fs, base), (_, piece_base) = pafs.FileSystem.from_uri(folder), pafs.FileSystem.from_uri(kept)
        fs.create_dir(base, recursive=True)
        current, out, n = None, None, 0
        for batch in batches:
            for name, piece, rows in zip(*(batch[c].to_pylist() for c in ("file_name", "piece", "rows"))):
                if name != current:
                    if out is not None:
                        out.close()
                        yield pa.RecordBatch.from_pydict({"file_name": [current], "rows": [n]})
                    current, n = name, 0
                    out = fs.open_output_stream(f"{base}/{name}")
                with fs.open_input_stream(f"{piece_base}/{name}.{piece}", compression=PIECE_CODEC) as text:
                    shutil.copyfileobj(text, out, 8 << 20)
                n += rows
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file_name": [current], "rows": [n]})

    pieces = spread.select("file_name", "piece", "text").mapInArrow(write, "file_name STRING, piece BIGINT, rows BIGINT")
    with shuffles_removed(rows.sparkSession):
        pieces = stage(pieces, f"{kept}/written")
    together = pieces.repartition(n, "file_name").sortWithinPartitions("file_name", "piece")
    return together.mapInArrow(join, "file_name STRING, rows BIGINT")


def write_logs(rows: DataFrame, folder: str) -> None:
    """Runs ``write_files`` and removes the pieces."""
    try:
        with shuffles_removed(rows.sparkSession):
            write_files(rows, folder).agg(F.sum("rows")).collect()
    finally:
        delete(rows.sparkSession, pieces_folder(folder))


def render_logs(spark: SparkSession, sf_dir: str, folder: str) -> str:
    """Writes the driver's tables as a log directory and returns it."""
    text = slow_text(read(spark, sf_dir, "events")).unionByName(
        report_text(read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part"))
    )
    write_logs(text, folder)
    return folder
