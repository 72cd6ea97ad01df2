"""Chart helpers: one function's series on the overview's time grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPARSE_EVENTS = 3


def align_series(series: DataFrame, overview: DataFrame) -> DataFrame:
    """``series`` on the points of ``overview``: grid points without data become NULL rows,
    points off the grid are left out. An empty overview leaves the series unchanged.

    Both sides are bucketed to at most the chart's point limit.
    """
    grid = overview.select("t", F.lit(True).alias("_on"))
    has_grid = overview.agg(F.count(F.lit(1)) > 0).scalar()
    return (
        series.join(grid, "t", "full_outer")
        .filter(F.col("_on").isNotNull() | ~has_grid)
        .select(*series.columns)
        .orderBy("t")
    )


def hide_sparse_min(points: DataFrame) -> DataFrame:
    """The minimum is shown only where a bucket holds at least three events."""
    return points.withColumn(
        "min_execution_ms", F.when(F.col("event_count") >= SPARSE_EVENTS, F.col("min_execution_ms"))
    )


def shows_min(points: DataFrame) -> DataFrame:
    """Whether any bucket has a minimum worth showing."""
    enough = (F.col("event_count") >= SPARSE_EVENTS) & F.col("min_execution_ms").isNotNull()
    return points.agg(F.coalesce(F.bool_or(enough), F.lit(False)).alias("show_min"))
