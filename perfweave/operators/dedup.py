"""De-duplication against stored facts.

The rule is asymmetric on purpose. A first load keeps everything. Afterwards rows newer than
the high-water mark of their stream are kept as they are, repeats included; the others are
kept once, and only if not stored already.

A key may be hugely repeated, so neither side is joined row by row: new and stored rows are grouped
together by key, which combines copies on the map side before anything is shuffled. A group holds
fixed-width values only, so it is hash aggregated and nothing is sorted. Of the stored rows only the days
that the overlap itself touches are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfweave.functions.time import epoch_date

SLOW_KEY = ("source", "severity", "occurred_at", "execution_ms", "description", "detail")
CPU_KEY = ("source", "reported_at", "description_id", "time_ms", "calls", "rel_usage", "real_usage")
SLOW_STREAM = ("source", "severity")
CPU_STREAM = ("source",)


def high_water(facts: DataFrame, ts: str, stream: Sequence[str]) -> DataFrame:
    """Latest timestamp per stream (source, or source and severity)."""
    return facts.groupBy(*stream).agg(F.max(ts).alias("max_ts"))


def split_fresh(
    rows: DataFrame, marks: DataFrame, ts: str, stream: Sequence[str], unmarked_fresh: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(rows past their stream's mark, the others). Streams without a mark are all "others", unless told.

    ``marks`` has one row per configured source (and severity): a size fixed by configuration.
    """
    known = marks.select(*stream, F.col("max_ts").alias("_mark"))
    tagged = rows.join(F.broadcast(known), list(stream), "left").withColumn(
        "_fresh", F.coalesce(F.col(ts) > F.col("_mark"), F.lit(unmarked_fresh))
    )
    fresh = tagged.filter("_fresh").drop("_mark", "_fresh")
    return fresh, tagged.filter("NOT _fresh").drop("_mark", "_fresh")


def unseen(rows: DataFrame, stored: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row of every key in ``rows`` that does not occur in ``stored``.

    One shuffle on the key serves both the duplicate check among new rows and the anti join
    against stored ones. Which of several copies stays follows from a hash of the ``order`` columns, which
    should tell rows apart (the file and place a row comes from). Columns besides the key should be of
    fixed width: Spark has to sort the groups to carry texts along.
    """
    extra = [c for c in rows.columns if c not in key]
    apart = [c for c in order if c in extra] or extra
    both = rows.select("*", F.xxhash64(F.lit(0), *apart).alias("_place"), F.lit(False).alias("_stored")).unionByName(
        stored.select(*key, F.lit(True).alias("_stored")), allowMissingColumns=True
    )
    picked = both.groupBy(*key).agg(F.max("_stored").alias("_stored"), *[F.min_by(c, "_place").alias(c) for c in extra])
    return picked.filter("NOT _stored").select(*rows.columns)


def touched_days(stored: DataFrame, rows: DataFrame, ts: str) -> DataFrame:
    """Stored rows of the sources and days that ``rows`` has any of; none are read if it is empty.

    The days are a subquery of the same plan and prune the partitions of ``stored`` (by event_date) when
    it runs. There are as many as the duplicate horizon is long, for each configured source.
    """
    day = epoch_date(F.col(ts)).alias("event_date")
    days = rows.agg(F.collect_set(day)).scalar()
    pairs = rows.agg(F.collect_set(F.struct(F.col("source"), day))).scalar()
    near = F.array_contains(days, F.col("event_date"))
    return stored.filter(near).filter(F.array_contains(pairs, F.struct(F.col("source"), F.col("event_date"))))


def accept_rows(
    rows: DataFrame,
    stored: DataFrame,
    marks: DataFrame,
    ts: str,
    stream: Sequence[str],
    key: Sequence[str],
    incremental: bool,
    order: Sequence[str] = (),
    unmarked_fresh: bool = False,
) -> DataFrame:
    """The rows of ``rows`` an import keeps. ``stored`` need only cover the dedup horizon."""
    if not incremental:
        return rows
    fresh, overlap = split_fresh(rows, marks, ts, stream, unmarked_fresh)
    if "event_date" in stored.columns:
        stored = touched_days(stored, overlap, ts)
    return fresh.unionByName(unseen(overlap, stored, key, order))


def accept_slow(
    rows: DataFrame, stored: DataFrame, marks: DataFrame, incremental: bool, unmarked_fresh: bool = False
) -> DataFrame:
    return accept_rows(
        rows, stored, marks, "occurred_at", SLOW_STREAM, SLOW_KEY, incremental, ("file_no", "offset"), unmarked_fresh
    )


def accept_cpu(
    stats: DataFrame, stored: DataFrame, marks: DataFrame, incremental: bool, unmarked_fresh: bool = False
) -> DataFrame:
    return accept_rows(
        stats, stored, marks, "reported_at", CPU_STREAM, CPU_KEY, incremental,
        ("file_no", "offset", "stat_no"), unmarked_fresh,
    )
