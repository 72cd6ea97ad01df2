"""Pre-aggregated time buckets: 30 s overviews and hourly function totals.

Every aggregate has a partial form, so a dominant source, hour or function is combined on
the map side and reaches the shuffle as one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfweave.config import FUNCTION_GRAIN, OVERVIEW_GRAIN
from perfweave.functions.time import bucket_floor, epoch_date


def timed_stats(stats: DataFrame, reports: DataFrame | None) -> DataFrame:
    """Statistics with source, reported_at and players_online.

    Stored statistics carry them; otherwise they come from the report by an equi join.
    """
    missing = [c for c in ("source", "reported_at", "players_online") if c not in stats.columns]
    if not missing:
        return stats
    return stats.join(reports.select("report_id", *missing), "report_id")


def cpu_overview(reports: DataFrame) -> DataFrame:
    """Mean CPU usage and players per source and 30 s.

    The means ignore missing values while sample_count counts every report; the two extra
    counts allow an unbiased mean to be derived.
    """
    return reports.groupBy("source", bucket_floor("reported_at", OVERVIEW_GRAIN).alias("bucket_time")).agg(
        F.avg("cpu_usage").alias("avg_cpu_usage"),
        F.avg("players_online").alias("avg_players_online"),
        F.count(F.lit(1)).alias("sample_count"),
        F.count("cpu_usage").alias("cpu_usage_samples"),
        F.count("players_online").alias("players_online_samples"),
    )


def report_totals(stats: DataFrame, reports: DataFrame | None) -> DataFrame:
    """Summed real usage per report, with the report's source and time."""
    if {"source", "reported_at"} <= set(stats.columns):
        return stats.groupBy("report_id", "source", "reported_at").agg(
            F.sum("real_usage").alias("report_total")
        )
    # Summing first makes the join one row per report, on the key the sum is partitioned by.
    totals = stats.groupBy("report_id").agg(F.sum("real_usage").alias("report_total"))
    return totals.join(reports.select("report_id", "source", "reported_at"), "report_id")


def cpu_source_usage(stats: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """Mean over reports of their summed real usage, per source and 30 s."""
    return report_totals(stats, reports).groupBy(
        "source", bucket_floor("reported_at", OVERVIEW_GRAIN).alias("bucket_time")
    ).agg(
        F.avg("report_total").alias("avg_report_real_usage"),
        F.count(F.lit(1)).alias("report_count"),
    )


def cpu_function(stats: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """Totals per source, hour and function."""
    return timed_stats(stats, reports).groupBy(
        "source", bucket_floor("reported_at", FUNCTION_GRAIN).alias("bucket_time"), "description_id"
    ).agg(
        F.max("real_usage").alias("max_real_usage"),
        F.sum("real_usage").alias("sum_real_usage"),
        F.sum("time_ms").alias("sum_time_ms"),
        F.sum("calls").alias("sum_calls"),
        F.count(F.lit(1)).alias("sample_count"),
    )


def _slow(events: DataFrame, grain: int, *more: str) -> DataFrame:
    return events.groupBy("source", bucket_floor("occurred_at", grain).alias("bucket_time"), *more).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.min("execution_ms").alias("min_execution_ms"),
        F.max("execution_ms").alias("max_execution_ms"),
        F.sum("execution_ms").alias("sum_execution_ms"),
    )


def slow_overview(events: DataFrame) -> DataFrame:
    """Slow events per source and 30 s, both severities together."""
    return _slow(events, OVERVIEW_GRAIN)


def slow_function(events: DataFrame) -> DataFrame:
    """Slow events per source, hour and function."""
    return _slow(events, FUNCTION_GRAIN, "description_id")


def all_rollups(
    reports: DataFrame, stats: DataFrame, events: DataFrame
) -> dict[str, DataFrame]:
    """The five rollups by stored name."""
    return {
        "cpu_overview_agg": cpu_overview(reports),
        "cpu_source_usage_agg": cpu_source_usage(stats, reports),
        "cpu_function_bucket_agg": cpu_function(stats, reports),
        "slow_overview_agg": slow_overview(events),
        "slow_function_bucket_agg": slow_function(events),
    }


# Partial aggregates: what a part of the facts adds to a rollup. Parts of any cut merge to the whole, as means
# are kept as a sum and the number of values in it.


def _usage_partial(reports: DataFrame, stats: DataFrame) -> DataFrame:
    """Summed usage of the statistics and number of the reports, per source and 30 s.

    A report counts where its header row is, so statistics that come later do not count it again.
    """
    bucket = bucket_floor("reported_at", OVERVIEW_GRAIN).alias("bucket_time")
    none, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    parts = stats.select("source", bucket, F.col("real_usage").alias("_usage"), none.alias("_reports")).unionByName(
        reports.select("source", bucket, F.lit(0.0).alias("_usage"), one.alias("_reports"))
    )
    return parts.groupBy("source", "bucket_time").agg(
        F.sum("_usage").alias("sum_real_usage"), F.sum("_reports").alias("report_count")
    )


def partials(reports: DataFrame, stats: DataFrame, events: DataFrame) -> dict[str, DataFrame]:
    """Partial aggregates of all rollups by stored name; statistics carry source and time."""
    header = reports.groupBy("source", bucket_floor("reported_at", OVERVIEW_GRAIN).alias("bucket_time")).agg(
        F.sum("cpu_usage").alias("sum_cpu_usage"),
        F.sum("players_online").alias("sum_players_online"),
        F.count(F.lit(1)).alias("sample_count"),
        F.count("cpu_usage").alias("cpu_usage_samples"),
        F.count("players_online").alias("players_online_samples"),
    )
    frames = {
        "cpu_overview_agg": header,
        "cpu_source_usage_agg": _usage_partial(reports, stats),
        "cpu_function_bucket_agg": cpu_function(stats),
        "slow_overview_agg": slow_overview(events),
        "slow_function_bucket_agg": slow_function(events),
    }
    return {n: df.withColumn("event_date", epoch_date(F.col("bucket_time"))) for n, df in frames.items()}


_KEYS = ("source", "event_date", "bucket_time", "description_id")


def merged(name: str, parts: DataFrame) -> DataFrame:
    """A rollup from partial aggregates. Filters on its keys reach the parts."""
    how = {"min": F.min, "max": F.max}
    keys = [c for c in _KEYS if c in parts.columns]
    measures = [how.get(c.split("_")[0], F.sum)(c).alias(c) for c in parts.columns if c not in keys]
    whole = parts.groupBy(*keys).agg(*measures)
    if name == "cpu_overview_agg":
        return whole.withColumn("avg_cpu_usage", F.try_divide("sum_cpu_usage", "cpu_usage_samples")).withColumn(
            "avg_players_online", F.try_divide("sum_players_online", "players_online_samples")
        )
    if name == "cpu_source_usage_agg":
        return whole.withColumn("avg_report_real_usage", F.try_divide("sum_real_usage", "report_count"))
    return whole
