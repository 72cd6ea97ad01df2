"""What to read of every log file, and the per-file import state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfweave.functions.keys import file_no

# Actions that read something.
READING = ("replaced", "append", "seek", "full")


def resume_plan(files: DataFrame, state: DataFrame, import_cutoff: int | None) -> DataFrame:
    """Adds action, start_offset and shrunk to files that carry their fingerprint (first_line).

    skip_empty: nothing in it. replaced: another first line than last time, read from 0.
    up_to_date: read to its end already (``shrunk`` if it has become shorter). append: read on
    from the stored offset, or from the record that was open at the end then. seek: a new rolling log under a limited import window - reading may
    begin at the window. full: anything else.
    """
    known = state.select(
        "file_key",
        F.lit(True).alias("_known"),
        F.col("byte_offset").alias("_offset"),
        (F.col("open_offset") if "open_offset" in state.columns else F.lit(None).cast("bigint")).alias("_open"),
        F.col("first_line").alias("_first"),
        F.col("max_occurred_at").alias("prev_max_at"),
    )
    is_known = F.coalesce(F.col("_known"), F.lit(False))
    replaced = is_known & (F.col("_first") != F.col("first_line"))
    action = (
        F.when(F.col("file_size") == 0, "skip_empty")
        .when(replaced, "replaced")
        .when(is_known & (F.col("_offset") >= F.col("file_size")), "up_to_date")
        .when(is_known & (F.col("_offset") > 0), "append")
        .when(~is_known & F.col("is_rolling") & F.lit(import_cutoff is not None), "seek")
        .otherwise("full")
    )
    return (
        files.join(known, "file_key", "left")
        .withColumn("action", action)
        .withColumn(
            "start_offset",
            F.when(F.col("action") == "append", F.coalesce("_open", "_offset"))
            .when(F.col("action") == "up_to_date", F.col("file_size"))
            .otherwise(0)
            .cast("bigint"),
        )
        .withColumn("shrunk", (F.col("action") == "up_to_date") & (F.col("_offset") > F.col("file_size")))
        .drop("_known", "_offset", "_open", "_first")
    )


def upsert_state(state: DataFrame, updates: DataFrame) -> DataFrame:
    """New state snapshot: the latest row of every file; an update wins over an equally old row."""
    cols = state.columns
    rest = [c for c in cols if c not in ("file_key", "updated_at")]
    both = state.withColumn("_new", F.lit(False)).unionByName(
        updates.select(*cols).withColumn("_new", F.lit(True))
    )
    return both.groupBy("file_key").agg(F.max(F.struct("updated_at", "_new", *rest)).alias("_s")).select(
        *[F.col("file_key") if c == "file_key" else F.col(f"_s.{c}").alias(c) for c in cols]
    )


def status_report(state: DataFrame, tz: str = "UTC") -> DataFrame:
    """Import state per file with a readable latest timestamp in ``tz``, in file order."""
    utc = F.expr("timestampadd(SECOND, max_occurred_at, TIMESTAMP_NTZ'1970-01-01 00:00:00')")
    local = F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)
    return state.select(
        "file_key",
        "byte_offset",
        "file_size",
        F.date_format(local, "yyyy-MM-dd HH:mm:ss").alias("max_timestamp"),
    ).orderBy("file_key")


def ingest_audit(read: DataFrame, accepted: DataFrame) -> DataFrame:
    """Per file: lines read, rows inserted, rows skipped, bytes read, latest timestamp.

    ``read`` has (file_key, lines, rows, bytes); ``accepted`` has (file_no, ts), one row per
    stored row, with the file's number (``keys.file_no``). Both are pre-aggregated on the map side, so a dominant file is no hot spot.
    """
    seen = read.groupBy("file_key").agg(
        F.sum("lines").alias("lines_read"), F.sum("rows").alias("_rows"), F.sum("bytes").alias("bytes_read")
    )
    kept = accepted.groupBy("file_no").agg(
        F.count(F.lit(1)).alias("rows_inserted"), F.max("ts").alias("max_ts")
    )
    inserted = F.coalesce(F.col("rows_inserted"), F.lit(0).cast("bigint"))
    return seen.withColumn("file_no", file_no(F.col("file_key"))).join(kept, "file_no", "left").select(
        "file_key",
        "lines_read",
        inserted.alias("rows_inserted"),
        (F.col("_rows") - inserted).alias("rows_skipped"),
        "bytes_read",
        "max_ts",
    )
