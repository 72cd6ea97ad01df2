"""CPU report blocks.

    [d/m/yyyy h:m:s]
    Thread: 1 Cpu usage: 1.5% Idle: 98.4% Other: 0.1% Players online: 7      (optional)
     Time (ms)  Calls  Rel usage %  Real usage %  Description
          211    291     47.14838%      0.70414%  name, which may go on
    over further lines

One input row is one whole block, so everything here is a per-row expression: a block is
taken apart with string and array functions and exploded to its statistics. No shuffle and
no window over log text is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perfweave.functions import keys
from perfweave.functions.text import bytes_to_chars, chars_to_bytes, leading_float, trim_text
from perfweave.functions.time import parse_stamp

# Blanks within a line: a block's lines are joined by "\n", which must not count as one.
_WS = r"[ \t\x0B\f\r]"

# The header metrics line, the column header, the head of a statistics row.
_NUM = r"([\d.+\-]+)"
_META = (
    rf"Thread:{_WS}*(\d+){_WS}+Cpu usage:{_WS}*{_NUM}%{_WS}+Idle:{_WS}*{_NUM}%"
    rf"{_WS}+Other:{_WS}*{_NUM}%{_WS}+Players online:{_WS}*(\d+)"
)
_SCI_NUM = r"([\d.+\-eE]+)"
# A statistics row up to its name. No part can begin where the one before it goes on, so none is tried again shorter.
_STATISTIC = rf"\n{_WS}++(\d++){_WS}++(\d++){_WS}++([\d.]++)%{_WS}++([\d.]++)%{_WS}++"
_HEADER = "Time (ms)"
# No characters of the text, all of which are bytes: before a statistic, and behind each of its figures.
_CUT = "\u0100"
_FIELD = "\u0101"
_NAMELESS = rf"{_FIELD}(?=[\n{_CUT}]|\z)"
_MAX_LONG = 9223372036854775807


def _digits(s: Column) -> Column:
    """Digit string to BIGINT; longer numbers saturate."""
    return F.coalesce(s.try_cast("bigint"), F.lit(_MAX_LONG))


def _split(s: Column, pattern: str, groups: int) -> Column:
    """``s`` split where ``pattern`` matches and between its ``groups``.

    The pattern is compiled once and not for every row, as ``split`` does it.
    """
    return F.split(F.regexp_replace(s, pattern, "".join(f"${i}{_CUT}" for i in range(1, groups + 1))), _CUT)


def _nameless(marked: Column) -> Column:
    """Whether a text has a statistic without a name."""
    return marked.endswith(_FIELD) | marked.contains(f"{_FIELD}\n") | marked.contains(f"{_FIELD}{_CUT}")


def _number(s: Column) -> Column:
    """Plain number, or else the number the string begins with. Only ``sci_notation`` lets an exponent get here."""
    return F.coalesce(s.try_cast("double"), leading_float(s))


def parse_blocks(
    blocks: DataFrame, record_col: str = "record", log_tz: str = "UTC", sci_notation: bool = False
) -> DataFrame:
    """Adds status, lines, reported_at, the header metrics, n_stats and ``stat_texts`` to raw blocks.

    ``status``: ``ok`` (has statistics), ``empty`` (none), ``prelude`` (text before the first
    report of a file) or ``bad timestamp``. ``stat_texts`` has what precedes the first statistic, then one text
    per statistic, in order: its four figures, with a mark behind each, and its description with the lines that
    continue it. One pass over the body finds all statistics and takes them apart.
    ``sci_notation`` accepts header numbers such as 3.7e-05, which otherwise leave all five
    header metrics NULL.
    """
    meta = _META.replace(_NUM, _SCI_NUM) if sci_notation else _META
    header_line = rf"\n(?!{meta.replace('(', '(?:')})[^\n]*?Time \(ms\)[^\n]*(?:\n|\z)"
    raw, text, pre, body, found = (F.col(c) for c in ("_raw", "_text", "_pre", "_body", "_meta"))

    # Line ends lose every carriage return, then empty lines vanish.
    no_cr = F.when(raw.contains("\r"), F.regexp_replace(raw, r"\r+(?=\n|\z)", "")).otherwise(raw)
    tidy = F.rtrim(no_cr, F.lit("\n"))
    first_line = F.substring_index(text, "\n", 1)
    is_block = first_line.rlike(r"^\[\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}\]")
    stamp = F.substring(F.substring_index(first_line, "]", 1), 2, 32)

    marked = F.regexp_replace(body, _STATISTIC, _CUT + "".join(f"${i}{_FIELD}" for i in range(1, 5)))
    texts = F.split(marked, _CUT)
    n_nameless = F.when(_nameless(marked), F.regexp_count(marked, F.lit(_NAMELESS))).otherwise(0)

    def metric(i: int) -> Column:
        return F.get("_figures", F.lit(i - 1))

    cut = (
        blocks.withColumn("_raw", bytes_to_chars(F.col(record_col)))
        .withColumn("_tidy", tidy)
        .withColumn(
            "_text",
            F.when(F.col("_tidy").contains("\n\n"), F.regexp_replace("_tidy", r"\n{2,}", "\n")).otherwise(F.col("_tidy")),
        )
        .withColumn("_is_block", is_block)
        .withColumn("reported_at", F.when(F.col("_is_block"), parse_stamp(stamp, log_tz)))
        .withColumn("_pre", F.substring_index(text, _HEADER, 1))
        .withColumn("_plain", pre.contains("\n") & ~F.substring_index(pre, "\n", -1).startswith("Thread:"))
        .withColumn("_parts", F.when(~F.col("_plain"), F.split(text, header_line, 2)))
        .withColumn("_after", F.when(
            F.col("_plain"), F.substring(text, F.length(pre) + 1 + len(_HEADER), F.length(text))
        ))
        .withColumn("_pre", F.when(F.col("_plain"), pre).otherwise(F.get("_parts", F.lit(0))))
        .withColumn("_body", F.when(
            F.col("reported_at").isNotNull(),
            F.when(F.col("_plain"), F.substring(F.col("_after"), F.locate("\n", F.col("_after")), F.length("_after")))
            .otherwise(F.concat(F.lit("\n"), F.get("_parts", F.lit(1)))),
        ))
        # The last header metrics line before the column header counts.
        .withColumn("_meta", F.when(pre.contains("Thread:"), F.regexp_extract(pre, rf"(?s)^.*\n({meta})", 1)))
        .withColumn("_figures", F.when(found != "", _split(found, meta, 5)))
        # Both in one projection, which computes what they have in common once.
        .withColumns({
            "_texts": texts,
            "n_stats": F.coalesce(F.array_size(texts) - 1 - n_nameless, F.lit(0)).cast("bigint"),
        })
    )
    has_meta = found != ""
    line_feeds = F.octet_length(raw) - F.octet_length(F.replace(raw, F.lit("\n")))
    return cut.select(
        *blocks.columns,
        F.when(~F.col("_is_block"), "prelude")
        .when(F.col("reported_at").isNull(), "bad timestamp")
        .when(F.col("n_stats") > 0, "ok")
        .otherwise("empty")
        .alias("status"),
        (line_feeds + F.when(raw.endswith("\n"), 0).otherwise(1)).cast("bigint").alias("lines"),
        "reported_at",
        F.when(has_meta, _digits(metric(1))).alias("thread_id"),
        F.when(has_meta, _number(metric(2))).alias("cpu_usage"),
        F.when(has_meta, _number(metric(3))).alias("idle"),
        F.when(has_meta, _number(metric(4))).alias("other"),
        F.when(has_meta, _digits(metric(5))).alias("players_online"),
        "n_stats",
        F.when(F.col("n_stats") > 0, F.col("_texts")).alias("stat_texts"),
    )


def identified(parsed: DataFrame) -> DataFrame:
    """Blocks with their report id; the parts of a long report have one."""
    offset = F.coalesce("report_offset", "offset") if "report_offset" in parsed.columns else F.col("offset")
    return parsed.withColumn(
        "report_id",
        keys.report_id(F.col("source"), F.col("reported_at"), F.col("file_key"), offset),
    )


def block_reports(parsed: DataFrame) -> DataFrame:
    """The header row of every block that has statistics."""
    reports = identified(parsed).filter("n_stats > 0")
    return reports.filter("report_offset IS NULL") if "report_offset" in parsed.columns else reports


def explode_stats(blocks: DataFrame) -> DataFrame:
    """One row per block (stat_no 0, statistics columns NULL) and one per statistic (from 1 on).

    Statistics without a name are dropped, with the lines that continue them. Column
    ``stat_texts`` is replaced by stat_no, description, time_ms, calls, rel_usage, real_usage.
    """
    keep = [c for c in blocks.columns if c != "stat_texts"]
    is_stat = F.col("stat_no") > 0

    def token(i: int) -> Column:
        return F.get("_token", F.lit(i))

    return (
        # What precedes the first statistic has position 0 and stands for the block. The outer
        # form keeps blocks without statistics; besides, the plain one would make Catalyst test
        # the array before exploding it, and so evaluate the whole parse twice.
        blocks.select(*keep, F.posexplode_outer("stat_texts").alias("_no", "_text"))
        .withColumn("stat_no", F.coalesce("_no", F.lit(0)))
        # On the text, as Catalyst would take it apart anew for each field that a filter names.
        .filter(~is_stat | ~_nameless(F.col("_text")))
        .withColumn("_token", F.when(is_stat, F.split("_text", _FIELD, 5)))
        .select(
            *keep,
            "stat_no",
            chars_to_bytes(trim_text(token(4))).alias("description"),
            F.when(is_stat, _digits(token(0))).alias("time_ms"),
            F.when(is_stat, _digits(token(1))).alias("calls"),
            F.when(is_stat, _number(token(2))).alias("rel_usage"),
            F.when(is_stat, _number(token(3))).alias("real_usage"),
        )
    )


def stats_only(exploded: DataFrame) -> DataFrame:
    """The statistics among exploded rows, with their dimension id."""
    more = [c for c in ("file_no", "is_open") if c in exploded.columns]
    return exploded.filter("stat_no > 0").select(
        *more,
        "file_key", "offset", "source", "report_id", "reported_at", "players_online", "stat_no", "description",
        "time_ms", "calls", "rel_usage", "real_usage",
        keys.description_id(F.col("source"), F.col("description")).alias("description_id"),
    )


def block_stats(blocks: DataFrame) -> DataFrame:
    """Statistics of identified blocks: one row each, with position in the block and dimension id."""
    return stats_only(explode_stats(blocks))


def cpu_quarantine(parsed: DataFrame, record_col: str = "record") -> DataFrame:
    """Blocks whose timestamp is not a date, with their whole text."""
    return parsed.filter("status = 'bad timestamp'").select(
        "file_key", "source", "offset", F.col("status").alias("reason"), F.col(record_col).cast("string").alias("line")
    )
