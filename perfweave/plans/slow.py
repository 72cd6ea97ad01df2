"""Slow-event read queries. Each returns a lazy DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perfweave.config import (
    DEFAULT_CONFIG,
    SLOW_SORTS,
    EngineConfig,
    TimeWindow,
    check_description_id,
    check_sort,
    latest,
)
from perfweave.functions.time import bucket_floor, in_window
from perfweave.operators.align import align_series
from perfweave.operators.bounds import meta_row
from perfweave.operators.dims import describe
from perfweave.plans.cpu import _of_source, _top
from perfweave.plans.routing import use_rollup
from perfweave.tables import LogTables

_SORT_COLUMN = {
    "count": "event_count",
    "max": "max_execution_ms",
    "avg": "avg_execution_ms",
    "total": "total_execution_ms",
}


def _rolled(tables: LogTables) -> frozenset[str] | None:
    return None if tables.rolled_sources is None else tables.rolled_sources["slow"]


def _window(tables: LogTables, end: int | Column | None, range_: str | None, config: EngineConfig) -> TimeWindow:
    if end is None:
        end = (tables.ends or {}).get("slow_events") or latest(tables.slow_events, "occurred_at")
    return config.window(end, range_ or config.default_range)


def slow_meta(tables: LogTables, config: EngineConfig = DEFAULT_CONFIG) -> DataFrame:
    named = {
        "slow_events": tables.slow_events,
        "descriptions": tables.descriptions,
        "slow_overview_agg": tables.slow_overview_agg,
        "slow_function_bucket_agg": tables.slow_function_bucket_agg,
    }
    named = {n: df for n, df in named.items() if df is not None}
    return meta_row(named, "slow_events", "occurred_at", "occurred_at", list(config.sources))


def _raw_measures() -> list[Column]:
    ms = F.col("execution_ms")
    return [
        F.count(F.lit(1)).alias("event_count"),
        F.min(ms).alias("min_execution_ms"),
        F.max(ms).alias("max_execution_ms"),
        F.sum(ms).alias("total_execution_ms"),
    ]


def _rollup_measures() -> list[Column]:
    return [
        F.sum("event_count").alias("event_count"),
        F.min("min_execution_ms").alias("min_execution_ms"),
        F.max("max_execution_ms").alias("max_execution_ms"),
        F.sum("sum_execution_ms").alias("total_execution_ms"),
    ]


_MEAN = "total_execution_ms / event_count AS avg_execution_ms"


def _points(rows: DataFrame, ts: str, window: TimeWindow, measures: list[Column]) -> DataFrame:
    return (
        rows.groupBy(bucket_floor(ts, window.bucket_seconds).alias("t"))
        .agg(*measures)
        .selectExpr("t", "event_count", "min_execution_ms", "max_execution_ms", _MEAN)
        .orderBy("t")
    )


def overview(
    tables: LogTables,
    source: str | None = None,
    end: int | Column | None = None,
    range_: str | None = None,
    mode: str = "auto",
    config: EngineConfig = DEFAULT_CONFIG,
) -> DataFrame:
    """t, event_count, min/max/avg execution_ms per bucket."""
    source = config.check_source(source)
    window = _window(tables, end, range_, config)
    if use_rollup(tables.slow_overview_agg, source, mode, _rolled(tables)):
        rows = in_window(_of_source(tables.slow_overview_agg, source), "bucket_time", window)
        return _points(rows, "bucket_time", window, _rollup_measures())
    rows = in_window(_of_source(tables.slow_events, source), "occurred_at", window)
    return _points(rows, "occurred_at", window, _raw_measures())


def top_functions(
    tables: LogTables,
    source: str | None = None,
    end: int | Column | None = None,
    range_: str | None = None,
    sort: str = "count",
    limit: int | None = None,
    mode: str = "auto",
    config: EngineConfig = DEFAULT_CONFIG,
) -> DataFrame:
    """Slow functions of a source; ties go to the smaller id."""
    source = config.check_source(source)
    sort_column = _SORT_COLUMN[check_sort(sort, SLOW_SORTS)]
    limit = config.clamp_limit(limit)
    window = _window(tables, end, range_, config)
    if use_rollup(tables.slow_function_bucket_agg, source, mode, _rolled(tables)):
        rows = in_window(_of_source(tables.slow_function_bucket_agg, source), "bucket_time", window)
        totals = rows.groupBy("description_id").agg(*_rollup_measures())
    else:
        rows = in_window(_of_source(tables.slow_events, source), "occurred_at", window)
        totals = rows.groupBy("description_id").agg(*_raw_measures())
    totals = totals.selectExpr(
        "description_id", "event_count", "min_execution_ms", "max_execution_ms", _MEAN, "total_execution_ms"
    )
    return _top(totals, sort_column, limit, tables.descriptions)


def function_series(
    tables: LogTables,
    description_id: int | Column,
    source: str | None = None,
    end: int | Column | None = None,
    range_: str | None = None,
    mode: str = "auto",
    config: EngineConfig = DEFAULT_CONFIG,
) -> DataFrame:
    """One function's slow events over time.

    From the rollup the points are hourly at best, whatever the chart bucket. ``source``
    (the function's own, looked up when not given) decides the routing and lets both tables
    prune. An unknown id is an error.
    """
    check_description_id(description_id)
    source = describe(tables.descriptions, description_id)[0] if source is None else config.check_source(source)
    window = _window(tables, end, range_, config)
    rollup = tables.slow_function_bucket_agg
    by_rollup = use_rollup(rollup, source, mode, _rolled(tables))
    rows = rollup if by_rollup else tables.slow_events
    rows = _of_source(rows, source).filter(F.col("description_id") == description_id)
    ts = "bucket_time" if by_rollup else "occurred_at"
    return _points(in_window(rows, ts, window), ts, window, _rollup_measures() if by_rollup else _raw_measures())


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
    series = function_series(tables, description_id, source, end, range_, mode, config)
    return align_series(series, overview(tables, source, end, range_, mode, config))


def window_summary(
    tables: LogTables,
    source: str | None = None,
    end: int | Column | None = None,
    range_: str | None = None,
    mode: str = "auto",
    config: EngineConfig = DEFAULT_CONFIG,
) -> DataFrame:
    """One row: event_count, max/avg execution_ms, exact number of distinct functions."""
    source = config.check_source(source)
    window = _window(tables, end, range_, config)
    pair = _summaries(tables, source, window, mode, with_previous=False)
    return pair.selectExpr(
        "current_event_count AS event_count",
        "current_max_execution_ms AS max_execution_ms",
        "current_avg_execution_ms AS avg_execution_ms",
        "current_unique_functions AS unique_functions",
    )


def _summaries(
    tables: LogTables, source: str, window: TimeWindow, mode: str, with_previous: bool
) -> DataFrame:
    """One row with a column group per window, from a single scan of the facts.

    The scan is reduced to one row per (window, function) first, so the distinct count is a
    plain count of groups and nothing is kept per event.
    """
    span = window.with_previous() if with_previous else window
    by_rollup = use_rollup(tables.slow_overview_agg, source, mode, _rolled(tables))

    def per_function(df: DataFrame, ts: str, measures: list[Column], *keys: str) -> DataFrame:
        is_now = (F.col(ts) > window.start).alias("is_now")
        return in_window(_of_source(df, source), ts, span).groupBy(is_now, *keys).agg(*measures)

    if by_rollup:
        # Counts come from the 30 s overview, distinct functions from the hourly rollup.
        events = per_function(tables.slow_overview_agg, "bucket_time", _rollup_measures()).select(
            "*", F.lit(0).alias("functions")
        )
        names = per_function(
            tables.slow_function_bucket_agg, "bucket_time", [F.lit(1).alias("functions")], "description_id"
        ).select("is_now", "functions")
        groups = events.unionByName(names, allowMissingColumns=True)
    else:
        groups = per_function(tables.slow_events, "occurred_at", _raw_measures(), "description_id").select(
            "*", F.lit(1).alias("functions")
        )

    return groups.agg(*_both_sides())


def _both_sides() -> list[Column]:
    """The measures of both windows from groups with ``is_now``, counts and ``functions``."""
    out = []
    for name, when in (("current", F.col("is_now")), ("previous", ~F.col("is_now"))):
        n = F.coalesce(F.sum(F.when(when, F.col("event_count"))), F.lit(0)).cast("bigint")
        total = F.sum(F.when(when, F.col("total_execution_ms")))
        out += [
            n.alias(f"{name}_event_count"),
            F.max(F.when(when, F.col("max_execution_ms"))).alias(f"{name}_max_execution_ms"),
            F.when(n > 0, total / n).alias(f"{name}_avg_execution_ms"),
            F.coalesce(F.sum(F.when(when, F.col("functions"))), F.lit(0)).cast("bigint").alias(
                f"{name}_unique_functions"
            ),
        ]
    return out


def _pct(now: str, before: str) -> Column:
    before_, now_ = F.col(before).cast("double"), F.col(now).cast("double")
    return F.when(before_ != 0, (now_ - before_) / before_ * 100.0)


def comparison(
    tables: LogTables,
    source: str | None = None,
    end: int | Column | None = None,
    range_: str | None = None,
    mode: str = "auto",
    config: EngineConfig = DEFAULT_CONFIG,
) -> DataFrame:
    """A window against the equally long one before it: one row with both and percent changes.

    A change is NULL where either side is missing or the earlier one is zero.
    """
    source = config.check_source(source)
    window = _window(tables, end, range_, config)
    return _summaries(tables, source, window, mode, with_previous=True).select("*", *_changes())


def _changes() -> list[Column]:
    return [
        _pct(f"current_{m}", f"previous_{m}").alias(f"{m}_pct")
        for m in ("event_count", "max_execution_ms", "avg_execution_ms")
    ]


def overview_with_comparison(
    tables: LogTables,
    source: str | None = None,
    end: int | Column | None = None,
    range_: str | None = None,
    mode: str = "auto",
    config: EngineConfig = DEFAULT_CONFIG,
) -> DataFrame:
    """One row: the columns of ``comparison``, and the rows of ``overview`` in ``points``, in order of time.

    Both come from one scan of both windows (of the 30 s rollup, with functions from the hourly one): it is reduced to
    one row per (bucket, function), and these to buckets and to functions. There are as many points as a range has buckets.
    """
    source = config.check_source(source)
    window = _window(tables, end, range_, config)
    span = window.with_previous()

    def of_bucket(ts: str) -> list[Column]:
        is_now = F.col(ts) > window.start
        return [is_now.alias("is_now"), F.when(is_now, bucket_floor(ts, window.bucket_seconds)).alias("t")]

    measures = ("event_count", "min_execution_ms", "max_execution_ms", "total_execution_ms")
    again = [
        (F.min if m.startswith("min") else F.max if m.startswith("max") else F.sum)(m).alias(m) for m in measures
    ]
    if use_rollup(tables.slow_overview_agg, source, mode, _rolled(tables)):
        rows = in_window(_of_source(tables.slow_overview_agg, source), "bucket_time", span)
        buckets = rows.groupBy(*of_bucket("bucket_time")).agg(*_rollup_measures()).withColumn("functions", F.lit(0))
        named = in_window(_of_source(tables.slow_function_bucket_agg, source), "bucket_time", span)
        functions = named.select((F.col("bucket_time") > window.start).alias("is_now"), "description_id").distinct().select(
            "is_now", F.lit(1).alias("functions"))
        groups = buckets.unionByName(functions, allowMissingColumns=True)
    else:
        rows = in_window(_of_source(tables.slow_events, source), "occurred_at", span)
        fine = rows.groupBy(*of_bucket("occurred_at"), "description_id").agg(*_raw_measures())
        sets = [[F.col("is_now"), F.col("t")], [F.col("is_now"), F.col("description_id")]]
        either = fine.groupingSets(sets, "is_now", "t", "description_id").agg(
            F.grouping("t").alias("functions"), *again)
        # A function's row only counts it: the events are in the buckets' rows.
        groups = either.select("is_now", "t", "functions", *[F.when(F.col("functions") == 0, F.col(m)).alias(m) for m in measures])
    point = F.struct("t", "event_count", "min_execution_ms", "max_execution_ms", F.expr(_MEAN))
    points = F.array_sort(F.collect_list(F.when(F.col("is_now") & (F.col("functions") == 0), point)))
    return groups.agg(*_both_sides(), points.alias("points")).select("*", *_changes())
