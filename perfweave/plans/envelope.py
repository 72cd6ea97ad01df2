"""What a result answers: the source, the window and the bucket behind a query's points.

With a default end a caller cannot tell the window from the points, so it is given as a row of its own, from
the same parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perfweave.config import DEFAULT_CONFIG, EngineConfig, check_description_id
from perfweave.functions.text import clean_text
from perfweave.plans import cpu, slow
from perfweave.tables import LogTables

# How each kind of query resolves its window.
_WINDOWS = {"cpu": cpu._window, "slow": slow._window}


def envelope(
    tables: LogTables,
    kind: str,
    source: str | None = None,
    end: int | Column | None = None,
    range_: str | None = None,
    description_id: int | Column | None = None,
    config: EngineConfig = DEFAULT_CONFIG,
) -> DataFrame:
    """One row: source, range, start, end, bucket_seconds; for a function also description_id and description.

    ``kind`` is ``cpu`` or ``slow``. Parameters are those of the query and resolved alike. Points lie in
    ``(start, end]``; without any fact and without an ``end`` both are null. A function's source is its own,
    and an id that is not known gives no row.
    """
    if kind not in _WINDOWS:
        raise ValueError(f"Invalid kind: {kind}")
    window = _WINDOWS[kind](tables, end, range_, config)
    bounds = [
        F.lit(range_ or config.default_range).alias("range"),
        (F.lit(window.start) if isinstance(window.start, int) else window.start).cast("bigint").alias("start"),
        (F.lit(window.end) if isinstance(window.end, int) else window.end).cast("bigint").alias("end"),
        F.lit(window.bucket_seconds).alias("bucket_seconds"),
    ]
    if description_id is None:
        one = tables.descriptions.sparkSession.range(1)
        return one.select(F.lit(config.check_source(source)).alias("source"), *bounds)
    check_description_id(description_id)
    named = tables.descriptions.filter(F.col("description_id") == description_id)
    return named.select("source", *bounds, "description_id", clean_text(F.col("description")).alias("description")).limit(1)
