"""Epoch-second arithmetic and the log timestamp format, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perfweave.config import TimeWindow

# Fixed value: the shape of a log timestamp, without its brackets.
STAMP_PATTERN = r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}$"


def bucket_floor(ts: str, seconds: int) -> Column:
    """``ts`` rounded down to a multiple of ``seconds`` (integer division)."""
    return F.expr(f"(`{ts}` div {int(seconds)}L) * {int(seconds)}L")


def epoch_date(ts: Column | int) -> Column:
    """UTC calendar date of an epoch second, whatever the session time zone is."""
    days = F.floor((F.lit(ts) if isinstance(ts, int) else ts) / F.lit(86400))
    return F.date_from_unix_date(days.cast("int"))


def parse_stamp(stamp: Column, log_tz: str = "UTC") -> Column:
    """Epoch second of ``d/m/yyyy h:m:s``; NULL for other shapes and impossible dates."""
    zoned = F.concat(stamp, F.lit(f" {log_tz}"))
    made = F.try_to_timestamp(zoned, F.lit("d/M/yyyy H:m:s VV"))
    return F.when(stamp.rlike(STAMP_PATTERN), F.unix_seconds(made))


def in_window(df: DataFrame, ts: str, window: TimeWindow) -> DataFrame:
    """Rows with ``start < ts <= end``; prunes date partitions where the table has them."""
    start, end = window.start, window.end
    cond = (F.col(ts) > start) & (F.col(ts) <= end)
    if "event_date" in df.columns:
        # Rollup buckets never cross a UTC day, so the same bounds hold for bucket_time.
        cond &= F.col("event_date").between(epoch_date(start), epoch_date(end))
    return df.filter(cond)
