"""Query and import parameters, resolved on the driver while a plan is built."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Range lengths and default bucket widths in seconds.
RANGE_SECONDS = {"hour": 3600, "day": 86400, "7d": 604800, "14d": 1209600, "30d": 2592000}
BUCKET_SECONDS = {"hour": 30, "day": 60, "7d": 300, "14d": 600, "30d": 1800}
SOURCES = ("dispatcher", "lua", "sql", "special")

# Grain of the stored rollups in seconds.
OVERVIEW_GRAIN = 30
FUNCTION_GRAIN = 3600

CPU_SORTS = ("max", "avg", "total")
SLOW_SORTS = ("count", "max", "avg", "total")
MODES = ("auto", "raw", "rollup")


@dataclass(frozen=True)
class TimeWindow:
    """Left-open, right-closed interval ``(start, end]`` with its chart bucket.

    ``end`` is a number, or a one-row subquery column when the caller asked for
    "up to the latest row"; ``start`` follows from it either way.
    """

    end: int | Column
    duration: int
    bucket_seconds: int

    @property
    def start(self) -> int | Column:
        return self.end - self.duration

    def previous(self) -> TimeWindow:
        """The window of equal length that ends where this one starts."""
        return TimeWindow(self.start, self.duration, self.bucket_seconds)

    def with_previous(self) -> TimeWindow:
        """This window and the previous one as a single interval."""
        return TimeWindow(self.end, 2 * self.duration, self.bucket_seconds)


@dataclass(frozen=True)
class EngineConfig:
    sources: Sequence[str] = SOURCES
    header_source: str = "dispatcher"
    ranges: Mapping[str, int] = field(default_factory=lambda: dict(RANGE_SECONDS))
    buckets: Mapping[str, int] = field(default_factory=lambda: dict(BUCKET_SECONDS))
    max_points: int = 1500
    default_range: str = "day"
    top_limit: int = 50
    dedup_days: int = 7
    import_days: int = 30
    log_tz: str = "UTC"
    range_bytes: int = 128 * 1024 * 1024

    def __post_init__(self) -> None:
        if self.import_days < 0:
            raise ValueError("import_days must be >= 0 (0 = no limit)")

    @property
    def default_source(self) -> str:
        return self.header_source

    def bucket_seconds(self, range_: str) -> int:
        """Chart bucket: the range's default, widened to respect the point cap."""
        if range_ not in self.ranges:
            raise ValueError(f"Invalid range: {range_}")
        return max(self.buckets.get(range_, 30), ceil(self.ranges[range_] / self.max_points))

    def window(self, end: int | Column, range_: str) -> TimeWindow:
        bucket = self.bucket_seconds(range_)
        if not isinstance(end, Column) and end <= 0:
            raise ValueError("Invalid end timestamp")
        return TimeWindow(end, self.ranges[range_], bucket)

    def check_source(self, source: str | None) -> str:
        source = self.default_source if source is None else source
        if source not in self.sources:
            raise ValueError(f"Invalid source: {source}")
        return source

    def clamp_limit(self, limit: int | None) -> int:
        return max(1, min(self.top_limit if limit is None else limit, self.top_limit))

    def import_cutoff(self, now: int) -> int | None:
        return now - self.import_days * 86400 if self.import_days > 0 else None

    def dedup_cutoff(self, now: int) -> int:
        return now - self.dedup_days * 86400


DEFAULT_CONFIG = EngineConfig()


def check_sort(sort: str, allowed: Sequence[str]) -> str:
    if sort not in allowed:
        raise ValueError(f"Invalid sort: {sort}")
    return sort


def check_mode(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"Invalid mode: {mode}")
    return mode


def check_description_id(description_id: int | Column) -> int | Column:
    if not isinstance(description_id, Column) and description_id <= 0:
        raise ValueError("Invalid description_id")
    return description_id


def latest(df: DataFrame, ts_col: str) -> Column:
    """Latest timestamp of a fact as a scalar subquery: the default window end.

    It stays part of the one plan, and partition filters built on it prune at run time.
    """
    return df.agg(F.max(ts_col)).scalar()
