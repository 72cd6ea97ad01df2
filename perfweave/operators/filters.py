"""Row filters of an import run. ``now`` is always an argument, never the wall clock."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_import_window(rows: DataFrame, ts: str, cutoff: int | None) -> DataFrame:
    """Rows not older than the import window; all rows when it is unlimited."""
    return rows if cutoff is None else rows.filter(F.col(ts) >= cutoff)


def keep_dedup_horizon(rows: DataFrame, ts: str, cutoff: int, incremental: bool) -> DataFrame:
    """In an incremental run, rows too old to be checked for duplicates are dropped."""
    return rows.filter(F.col(ts) >= cutoff) if incremental else rows
