"""CPU read queries. Each returns a lazy DataFrame of points or functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perfweave.config import (
    CPU_SORTS,
    DEFAULT_CONFIG,
    EngineConfig,
    TimeWindow,
    check_description_id,
    check_sort,
    latest,
)
from perfweave.functions.text import clean_text
from perfweave.functions.time import bucket_floor, in_window
from perfweave.operators.align import align_series
from perfweave.operators.bounds import meta_row
from perfweave.operators.dims import describe
from perfweave.operators.rollups import report_totals, timed_stats
from perfweave.plans.routing import use_rollup
from perfweave.tables import LogTables

_SORT_COLUMN = {"max": "max_real_usage", "avg": "avg_real_usage", "total": "total_time_ms"}


def _rolled(tables: LogTables) -> frozenset[str] | None:
    return None if tables.rolled_sources is None else tables.rolled_sources["cpu"]


def _window(tables: LogTables, end: int | Column | None, range_: str | None, config: EngineConfig) -> TimeWindow:
    if end is None:
        end = (tables.ends or {}).get("cpu_reports") or latest(tables.cpu_reports, "reported_at")
    return config.window(end, range_ or config.default_range)


def _of_source(df: DataFrame, source: str) -> DataFrame:
    return df.filter(F.col("source") == source)


def cpu_meta(tables: LogTables, config: EngineConfig = DEFAULT_CONFIG) -> DataFrame:
    named = {
        "descriptions": tables.descriptions,
        "cpu_reports": tables.cpu_reports,
        "cpu_stats": tables.cpu_stats,
        "slow_events": tables.slow_events,
    }
    named = {n: df for n, df in named.items() if df is not None}
    return meta_row(named, "cpu_reports", "reported_at", "reported_at", list(config.sources))


def overview(
    tables: LogTables,
    source: str | None = None,
    end: int | Column | None = None,
    range_: str | None = None,
    mode: str = "auto",
    config: EngineConfig = DEFAULT_CONFIG,
) -> DataFrame:
    """Activity over time: header metrics for the header source, summed usage for others."""
    source = config.check_source(source)
    if source == config.header_source:
        return header_overview(tables, source, end, range_, mode, config)
    return source_usage(tables, source, end, range_, mode, config)


def header_overview(
    tables: LogTables,
    source: str | None = None,
    end: int | Column | None = None,
    range_: str | None = None,
    mode: str = "auto",
    config: EngineConfig = DEFAULT_CONFIG,
) -> DataFrame:
    """t, cpu_usage, players_online from the reports' header lines."""
    source = config.check_source(source)
    window = _window(tables, end, range_, config)
    if not use_rollup(tables.cpu_overview_agg, source, mode, _rolled(tables)):
        rows = in_window(_of_source(tables.cpu_reports, source), "reported_at", window)
        t = bucket_floor("reported_at", window.bucket_seconds).alias("t")
        return rows.groupBy(t).agg(
            F.avg("cpu_usage").alias("cpu_usage"), F.avg("players_online").alias("players_online")
        ).orderBy("t")
    rows = in_window(_of_source(tables.cpu_overview_agg, source), "bucket_time", window)
    n = F.sum("sample_count")
    # Weighted by all reports, also those without a header line: such buckets pull the mean down.
    return rows.groupBy(bucket_floor("bucket_time", window.bucket_seconds).alias("t")).agg(
        (F.sum(F.col("avg_cpu_usage") * F.col("sample_count")) / n).alias("cpu_usage"),
        (F.sum(F.col("avg_players_online") * F.col("sample_count")) / n).alias("players_online"),
    ).orderBy("t")


def source_usage(
    tables: LogTables,
    source: str,
    end: int | Column | None = None,
    range_: str | None = None,
    mode: str = "auto",
    config: EngineConfig = DEFAULT_CONFIG,
) -> DataFrame:
    """t, real_usage: mean over reports of their summed real usage."""
    source = config.check_source(source)
    window = _window(tables, end, range_, config)
    if use_rollup(tables.cpu_source_usage_agg, source, mode, _rolled(tables)):
        rows = in_window(_of_source(tables.cpu_source_usage_agg, source), "bucket_time", window)
        weighted = F.sum(F.col("avg_report_real_usage") * F.col("report_count")) / F.sum("report_count")
        return rows.groupBy(bucket_floor("bucket_time", window.bucket_seconds).alias("t")).agg(
            weighted.alias("real_usage")
        ).orderBy("t")
    stats, reports = tables.cpu_stats, tables.cpu_reports
    if {"source", "reported_at"} <= set(stats.columns):
        totals = report_totals(in_window(_of_source(stats, source), "reported_at", window), None)
    else:
        # The window thins out the reports before they meet the statistics.
        wanted = in_window(_of_source(reports, source), "reported_at", window).select("report_id", "reported_at")
        totals = stats.select("report_id", "real_usage").join(wanted, "report_id").groupBy(
            "report_id", "reported_at"
        ).agg(F.sum("real_usage").alias("report_total"))
    return totals.groupBy(bucket_floor("reported_at", window.bucket_seconds).alias("t")).agg(
        F.avg("report_total").alias("real_usage")
    ).orderBy("t")


def _windowed_stats(tables: LogTables, source: str, window: TimeWindow) -> DataFrame:
    """Statistics of a window, with reported_at and players_online."""
    stats = tables.cpu_stats
    if {"source", "reported_at", "players_online"} <= set(stats.columns):
        return in_window(_of_source(stats, source), "reported_at", window)
    return timed_stats(stats, in_window(_of_source(tables.cpu_reports, source), "reported_at", window))


def _top(totals: DataFrame, sort_column: str, limit: int, descriptions: DataFrame) -> DataFrame:
    """The first ``limit`` functions by ``sort_column``, named.

    Top-k comes before the join, so at most ``limit`` (a capped parameter) rows are
    broadcast against the dimension, however large that is.
    """
    order = [F.col(sort_column).desc(), F.col("description_id").asc()]
    top = totals.orderBy(*order).limit(limit)
    names = descriptions.select("description_id", "description")
    return names.join(F.broadcast(top), "description_id").select(
        "description_id", clean_text(F.col("description")).alias("description"),
        *[c for c in totals.columns if c != "description_id"],
    ).orderBy(*order)


def top_functions(
    tables: LogTables,
    source: str | None = None,
    end: int | Column | None = None,
    range_: str | None = None,
    sort: str = "total",
    limit: int | None = None,
    mode: str = "auto",
    config: EngineConfig = DEFAULT_CONFIG,
) -> DataFrame:
    """Functions of a source by cost; ties go to the smaller id."""
    source = config.check_source(source)
    sort_column = _SORT_COLUMN[check_sort(sort, CPU_SORTS)]
    limit = config.clamp_limit(limit)
    window = _window(tables, end, range_, config)
    if use_rollup(tables.cpu_function_bucket_agg, source, mode, _rolled(tables)):
        rows = in_window(_of_source(tables.cpu_function_bucket_agg, source), "bucket_time", window)
        totals = rows.groupBy("description_id").agg(
            F.max("max_real_usage").alias("max_real_usage"),
            (F.sum("sum_real_usage") / F.sum("sample_count")).alias("avg_real_usage"),
            F.sum("sum_time_ms").alias("total_time_ms"),
            F.sum("sum_calls").alias("total_calls"),
        )
    else:
        totals = _windowed_stats(tables, source, window).groupBy("description_id").agg(
            F.max("real_usage").alias("max_real_usage"),
            F.avg("real_usage").alias("avg_real_usage"),
            F.sum("time_ms").alias("total_time_ms"),
            F.sum("calls").alias("total_calls"),
        )
    return _top(totals, sort_column, limit, tables.descriptions)


def function_series(
    tables: LogTables,
    description_id: int | Column,
    source: str | None = None,
    end: int | Column | None = None,
    range_: str | None = None,
    config: EngineConfig = DEFAULT_CONFIG,
) -> DataFrame:
    """t and means of one function's statistics; always from raw facts.

    ``source`` is the function's own and is looked up when not given; an unknown id is an error.
    """
    check_description_id(description_id)
    source = describe(tables.descriptions, description_id)[0] if source is None else config.check_source(source)
    window = _window(tables, end, range_, config)
    narrowed = LogTables(
        tables.descriptions,
        cpu_reports=tables.cpu_reports,
        cpu_stats=tables.cpu_stats.filter(F.col("description_id") == description_id),
    )
    return _windowed_stats(narrowed, source, window).groupBy(
        bucket_floor("reported_at", window.bucket_seconds).alias("t")
    ).agg(
        F.avg("real_usage").alias("real_usage"),
        F.avg("time_ms").alias("time_ms"),
        F.avg("calls").alias("calls"),
        F.avg("players_online").alias("players_online"),
    ).orderBy("t")


def aligned_series(
    tables: LogTables,
    description_id: int | Column,
    source: str,
    end: int | Column | None = None,
    range_: str | None = None,
    mode: str = "auto",
    config: EngineConfig = DEFAULT_CONFIG,
) -> DataFrame:
    """A function's series on the time grid of its source's overview."""
    series = function_series(tables, description_id, source, end, range_, config)
    return align_series(series, overview(tables, source, end, range_, mode, config))
