"""Slow-execution events: one line each.

    [d/m/yyyy h:m:s] Execution time: <n> ms - <description> - <detail>
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfweave.functions.text import bytes_to_chars, chars_to_bytes, leading_int, trim_text
from perfweave.functions.time import parse_stamp

# The words around the fields.
_LEAD = "Execution time: "
_MS = " ms - "
_SEP = " - "


def parse_slow(lines: DataFrame, line_col: str = "line", log_tz: str = "UTC") -> DataFrame:
    """Adds status, occurred_at, execution_ms, description and detail to raw byte lines.

    ``status`` is ``ok``, ``blank`` or the reason for rejection; fields are NULL unless ok.
    Substring functions only: the fields have fixed delimiters, so no regular expression
    has to backtrack over a line. One character is one byte here.
    """
    line, rest, payload = F.col("_line"), F.col("_rest"), F.col("_payload")
    stamp = F.substring_index(line, "]", 1)
    ms_at = F.locate(_MS, rest, len(_LEAD) + 1)
    detail = F.substring_index(payload, _SEP, -1)
    head = F.left(payload, F.length(payload) - F.length(detail) - len(_SEP))
    named, told = F.col("_named"), F.col("_told")

    cut = (
        lines.withColumn("_line", F.rtrim(bytes_to_chars(F.col(line_col)), F.lit("\r\n")))
        .withColumn("_rest", F.when(line.startswith("[") & line.contains("]"), F.substring(line, F.length(stamp) + 3, F.length(line))))
        .withColumn("_payload", F.when(rest.startswith(_LEAD) & (ms_at > 0), F.substring(rest, ms_at + len(_MS), F.length(rest))))
        .withColumn("_split", payload.contains(_SEP))
        .withColumn("_at", F.when(F.col("_split"), parse_stamp(F.substring(stamp, F.lit(2), F.length(stamp)), log_tz)))
        .withColumn("_named", F.when(F.col("_split"), trim_text(head)))
        .withColumn("_told", F.when(F.col("_split"), trim_text(detail)))
    )
    # A detail that repeats or outgrows the name is the fuller name (SQL texts, long players).
    fuller = (told != "") & (told.startswith(named) | (F.length(told) > F.length(named)))
    status = (
        F.when(line == "", "blank")
        .when(F.col("_split").isNull() | ~F.col("_split"), "malformed")
        .when(F.col("_at").isNull(), "bad timestamp")
        .otherwise("ok")
    )
    ok = F.col("status") == "ok"
    found = (
        "status",
        F.when(ok, F.col("_at")).alias("occurred_at"),
        F.when(ok, leading_int(F.substring(rest, F.lit(len(_LEAD) + 1), ms_at - len(_LEAD) - 1))).alias("execution_ms"),
        F.when(ok, chars_to_bytes(F.when(fuller, told).otherwise(named))).alias("description"),
        F.when(ok, chars_to_bytes(told)).alias("detail"),
    )
    # A row of one generated row: a filter on the status is not moved below the generator, where it would
    # compute the fields anew for each time it names one.
    return cut.withColumn("status", status).select(*lines.columns, F.inline_outer(F.array(F.struct(*found))))


def slow_rows(parsed: DataFrame) -> DataFrame:
    return parsed.filter("status = 'ok'").drop("status")


def slow_quarantine(parsed: DataFrame) -> DataFrame:
    """Lines that are neither blank nor an event, with the reason."""
    return parsed.filter("status NOT IN ('ok', 'blank')").drop(
        "occurred_at", "execution_ms", "description", "detail"
    ).withColumnRenamed("status", "reason")
