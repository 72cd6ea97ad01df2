"""The frames a read query works on."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class LogTables:
    """Facts, dimension and (optionally) rollups; a query touches only what it needs.

    ``cpu_stats`` may carry ``source``, ``reported_at`` and ``players_online`` itself
    (the stored layout does); queries then skip the join to ``cpu_reports``.
    """

    descriptions: DataFrame
    cpu_reports: DataFrame | None = None
    cpu_stats: DataFrame | None = None
    slow_events: DataFrame | None = None
    cpu_overview_agg: DataFrame | None = None
    cpu_source_usage_agg: DataFrame | None = None
    cpu_function_bucket_agg: DataFrame | None = None
    slow_overview_agg: DataFrame | None = None
    slow_function_bucket_agg: DataFrame | None = None
    # What a store knows from its commit log, so that planning a query runs no job: the latest time of each
    # fact, and the sources whose rollups have rows, by kind ("slow", "cpu").
    ends: Mapping[str, int] | None = None
    rolled_sources: Mapping[str, frozenset[str]] | None = None
