"""The import: log files -> parsed stage -> accepted facts -> dimension, state, audit -> rollups.

All files go through one plan per kind. Raw text is read once: the parse is written to a
stage, and de-duplication, names, counts and state are computed from its few columns.

A run sees the store as of the last committed run. If another run is committed meanwhile, the parsed
rows are accepted anew against what that one stored; nothing is parsed again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perfweave.config import DEFAULT_CONFIG, EngineConfig
from perfweave.functions import keys
from perfweave.functions.time import epoch_date
from perfweave.operators.dedup import accept_cpu, accept_slow, high_water, split_fresh, touched_days
from perfweave.operators.dims import clashing_names, free_ids, moved_names, new_names, with_ids
from perfweave.operators.filters import keep_dedup_horizon, keep_import_window
from perfweave.operators.parse_cpu import explode_stats, identified, parse_blocks, stats_only
from perfweave.operators.parse_slow import parse_slow
from perfweave.operators.resume import READING, ingest_audit, resume_plan
from perfweave.plans.store import FACTS, Store, delete, run_together, shuffles_removed, stage
from perfweave.schemas import PARTIALS
from perfweave.sources.catalog import list_logs
from perfweave.sources.ranges import (
    CONTINUES,
    cut_ranges,
    range_count,
    read_records,
    with_fingerprints,
    with_open_tail,
    with_seek_offsets,
)


# From this much log text on, a run's facts are clustered by source within a day.
LARGE_RUN_BYTES = 4 * 1024**3
# How often a run is accepted anew because another one was quicker.
MOST_ATTEMPTS = 50


class NamesClash(Exception):
    """Names met in a run have one id."""


@dataclass(frozen=True)
class ImportRun:
    run_id: int | None
    files_read: int


def plan_files(
    spark: SparkSession, data_dir: str, state: DataFrame, now: int, config: EngineConfig = DEFAULT_CONFIG
) -> DataFrame:
    """Every log file with what to do about it and where reading starts.

    A new rolling log under a limited import window starts at its first line inside the window
    (action ``seek``), or is left alone if it has none (``skip_outside``).
    """
    cutoff = config.import_cutoff(now)
    plan = resume_plan(with_fingerprints(list_logs(spark, data_dir, config)), state, cutoff)
    if cutoff is None:
        return plan
    at = with_seek_offsets(plan.filter("action = 'seek'"), cutoff, config.log_tz)
    outside = F.col("seek_offset") >= F.col("file_size")
    sought = at.withColumn("start_offset", F.col("seek_offset")).withColumn(
        "action", F.when(outside, "skip_outside").otherwise("seek")
    )
    return plan.filter("action <> 'seek'").unionByName(sought.drop("seek_offset"))


def keep_slow_columns(parsed: DataFrame) -> DataFrame:
    """Parsed lines as staged: sizes for the audit, text for rejected lines only."""
    rejected = ~F.col("status").isin("ok", "blank")
    return parsed.withColumn("bytes", F.octet_length("record").cast("bigint")).withColumn(
        "line", F.when(rejected, F.col("record").cast("string"))
    ).drop("record", "range_start", *CONTINUES)


def keep_cpu_columns(parsed: DataFrame) -> DataFrame:
    """Parsed blocks and their statistics as staged, so that no later step parses again.

    Rejected blocks keep their text. ``is_part`` marks what continues a long report; the head that was put
    before it does not count.
    """
    def head(size: str) -> Column:
        return F.coalesce(F.col(size), F.lit(0).cast("bigint"))

    parsed = parsed.withColumns({c: F.lit(None).cast("bigint") for c in CONTINUES if c not in parsed.columns})
    sized = parsed.withColumns({
        "bytes": F.octet_length("record").cast("bigint") - head("head_bytes"),
        "lines": F.col("lines") - head("head_lines"),
        "line": F.when(F.col("status") == "bad timestamp", F.col("record").cast("string")),
        "is_part": F.col("report_offset").isNotNull(),
    })
    return explode_stats(identified(sized.drop("record", "range_start", "severity")).drop(*CONTINUES))


def parse_slow_files(plan: DataFrame, n_ranges: int, config: EngineConfig, hold_open: bool) -> DataFrame:
    """All lines of the planned slow logs, parsed."""
    lines = read_records(cut_ranges(plan, config.range_bytes, n_ranges), blocks=False, hold_open=hold_open)
    return keep_slow_columns(parse_slow(lines, "record", config.log_tz))


def parse_cpu_files(plan: DataFrame, n_ranges: int, config: EngineConfig, hold_open: bool) -> DataFrame:
    """All blocks of the planned CPU logs, parsed."""
    blocks = read_records(cut_ranges(plan, config.range_bytes, n_ranges), blocks=True, hold_open=hold_open)
    return keep_cpu_columns(parse_blocks(blocks, "record", config.log_tz))


def _quarantine(parsed: DataFrame) -> DataFrame:
    return parsed.filter("line IS NOT NULL AND NOT is_open").select(
        "file_key", "source", "offset", F.col("status").alias("reason"), "line"
    )


def import_logs(
    spark: SparkSession,
    data_dir: str,
    store: Store,
    now: int,
    config: EngineConfig = DEFAULT_CONFIG,
    finalize: bool | None = None,
) -> ImportRun:
    """Imports what is new under ``data_dir``.

    The end of a file may still be written to (an open report, a line without its line feed). By default
    what is there counts at once, and the next run that finds the file grown reads on from the start of that
    record and puts its final rows in their place. With ``finalize=True`` the end is taken as complete for
    good, with ``finalize=False`` it is left alone until it is.
    """
    scratch = store.scratch()
    try:
        with shuffles_removed(spark):
            return _import(spark, data_dir, store, now, config, finalize, scratch)
    finally:
        delete(spark, scratch)


def _import(
    spark: SparkSession, data_dir: str, store: Store, now: int, config: EngineConfig, finalize: bool | None, scratch: str
) -> ImportRun:
    plan = plan_files(spark, data_dir, store.state(), now, config)
    todo = plan.filter(F.col("action").isin(*READING))
    if finalize:
        todo = todo.withColumn("open_offset", F.col("file_size")).withColumn("whole_first", F.lit(True))
    else:
        todo = with_open_tail(todo)
    todo = stage(todo, f"{scratch}/plan")
    size = todo.agg(
        F.count(F.lit(1)).alias("files"), F.sum(F.col("file_size") - F.col("start_offset")).alias("bytes")
    ).first()
    if size["files"] == 0:
        return ImportRun(None, 0)

    hold = finalize is False
    slow_files, cpu_files = todo.filter("type <> 'cpu'"), todo.filter("type = 'cpu'")

    def parsed(parse, files: DataFrame, name: str) -> DataFrame:
        return stage(parse(files, range_count(files, config.range_bytes), config, hold), f"{scratch}/{name}")

    slow, cpu = run_together([
        partial(parsed, parse_slow_files, slow_files, "slow"),
        partial(parsed, parse_cpu_files, cpu_files, "cpu"),
    ])

    def read_files(audited: DataFrame) -> DataFrame:
        """The state of the files read: read to their end, or to the record left alone."""
        unfinished = F.col("open_offset") < F.col("file_size")
        to = F.when(unfinished, F.col("open_offset")).otherwise(F.col("file_size")) if hold else F.col("file_size")
        return audited.withColumn("byte_offset", to).withColumn(
            "open_offset", F.when(unfinished & F.lit(not hold), F.col("open_offset"))
        ).withColumn(
            # Half a first line is no fingerprint.
            "first_line", F.when(F.col("whole_first"), F.col("first_line"))
        ).withColumn("max_occurred_at", F.greatest("prev_max_at", "max_ts")).withColumn(
            "updated_at", F.lit(now).cast("bigint")
        )

    run_id = load_rows(
        store, slow, cpu, todo, read_files, scratch, now, config, by_source=size["bytes"] >= LARGE_RUN_BYTES
    )
    return ImportRun(run_id, size["files"])


def load_rows(
    store: Store,
    slow: DataFrame,
    cpu: DataFrame,
    files: DataFrame,
    read_files: Callable[[DataFrame], DataFrame] | None,
    scratch: str,
    now: int,
    config: EngineConfig,
    marks: Sequence[str] = (),
    by_source: bool = False,
) -> int | None:
    """Stores parsed rows as a new run: facts, names, rejects, audit, state, high-water marks, rollups.

    ``slow`` and ``cpu`` are staged parser output. ``files`` (file_key, source, action, ...) lists
    the files read; ``read_files`` turns it, joined with the counts, into their state. ``marks`` name
    what is stored: if a run carries one of them already, nothing is done and None returned.

    Ids of names are taken to differ, as they nearly always do. If two of them clash, the run is written once
    more with another id for one of them.
    """
    first_load, resolve = not store.committed(), False
    for attempt in range(MOST_ATTEMPTS):
        before = store.committed()
        if any(store.has_mark(m) for m in marks):
            return None
        number = len(before) + 1
        folder = store.folder(number)
        try:
            wrote, high = _write_run(
                store, slow, cpu, files, read_files, f"{scratch}/{attempt}", now, config, folder, by_source,
                bool(before), first_load, resolve,
            )
        except NamesClash:
            resolve = True
            continue
        if store.commit(number, folder, wrote, now, marks=list(marks), high_water=high, moved_names=resolve):
            return number
    raise RuntimeError(f"{MOST_ATTEMPTS} other runs were quicker")


def _write_run(
    store: Store, slow: DataFrame, cpu: DataFrame, files: DataFrame, read_files: Callable[[DataFrame], DataFrame] | None,
    scratch: str, now: int, config: EngineConfig, folder: str, by_source: bool, incremental: bool, first_load: bool,
    resolve: bool = False,
) -> tuple[dict[str, dict], list[list]]:
    """Writes a run's tables into ``folder``; returns what its record says of them, and its high-water marks.

    A first load that another run overtook is checked against that one whole: no row is too old for it.
    Names that clash raise ``NamesClash``, or with ``resolve`` get ids of their own.
    """
    known_marks = store.high_water()
    cutoff = config.import_cutoff(now)
    horizon = None if first_load else config.dedup_cutoff(now)

    def in_scope(rows: DataFrame, ts: str) -> DataFrame:
        rows = keep_import_window(rows, ts, cutoff)
        return rows if horizon is None else keep_dedup_horizon(rows, ts, horizon, incremental)

    def stored(table: str, ts: str) -> DataFrame:
        if horizon is None:
            return store.closed(table)
        since = datetime.fromtimestamp(horizon, timezone.utc).date()
        recent = F.col("event_date") >= epoch_date(F.lit(horizon))
        return store.closed(table, since).filter(recent & (F.col(ts) >= horizon))

    def placed(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("file_no", keys.file_no(F.col("file_key")))
        return rows if "is_open" in rows.columns else rows.withColumn("is_open", F.lit(False))

    slow, cpu = placed(slow), placed(cpu)

    # What is accepted
    cpu_marks = known_marks.filter("severity IS NULL").drop("severity")
    slow_marks = known_marks.filter("severity IS NOT NULL")
    events = in_scope(slow.filter("status = 'ok'"), "occurred_at").select(
        "file_no", "offset", "is_open", "source", "severity", "occurred_at", "execution_ms", "description", "detail"
    )
    blocks = cpu.filter("stat_no = 0")
    reports = in_scope(blocks.filter("n_stats > 0 AND NOT is_part"), "reported_at")
    stats = in_scope(stats_only(cpu), "reported_at")
    # Names of rows that turn out to be stored are known already, so all may be offered.
    named = events.select("source", "description").unionByName(stats.select("source", "description"))
    known_names, moved = store.closed("descriptions"), None
    new = new_names(named, known_names)
    if resolve:
        new = free_ids(new, known_names, lambda df, name: stage(df, f"{scratch}/{name}"))
        moved = moved_names(known_names.unionByName(new))
    elif store.has_moved_names():
        moved = moved_names(known_names)
    if moved is not None:
        stats = with_ids(stats, moved)
    stats = stats.drop("description", "file_key")
    left = _left_open(store, files)
    if left is not None:
        # Files that were replaced: what was open at their end is finished now, and in no file any more.
        old_reports, old_stats, old_events = left
        events = events.unionByName(old_events, allowMissingColumns=True)
        stats = stats.unionByName(old_stats, allowMissingColumns=True)
        reports = reports.unionByName(old_reports, allowMissingColumns=True)
    events = accept_slow(events, stored("slow_events", "occurred_at"), slow_marks, incremental, first_load)
    stats = accept_cpu(stats, stored("cpu_stats", "reported_at"), cpu_marks, incremental, first_load)
    if incremental:
        events, stats = run_together([
            partial(stage, events, f"{scratch}/kept_slow"), partial(stage, stats, f"{scratch}/kept_cpu")
        ])
        # A report is stored if any of its statistics is, unless it has been; past the mark all of them are.
        fresh, overlap = split_fresh(reports, cpu_marks, "reported_at", ("source",), first_load)
        there = touched_days(stored("cpu_reports", "reported_at"), overlap, "reported_at").select("report_id")
        again = overlap.join(stats.select("report_id"), "report_id", "left_semi").join(there, "report_id", "left_anti")
        reports = fresh.unionByName(again)

    # Counts per file
    lines_and_rows = slow.select(
        "file_key", F.lit(1).alias("lines"), (F.col("status") == "ok").cast("bigint").alias("rows"), "bytes"
    ).unionByName(
        blocks.select("file_key", "lines", F.col("n_stats").alias("rows"), "bytes")
    )
    accepted = events.select("file_no", F.col("occurred_at").alias("ts")).unionByName(
        stats.select("file_no", F.col("reported_at").alias("ts"))
    )

    def write_counts() -> dict[str, dict]:
        counted = stage(ingest_audit(lines_and_rows, accepted), f"{scratch}/audit")
        audited = files.join(counted, "file_key", "left")
        zero = F.lit(0).cast("bigint")
        audit = audited.select(
            "file_key", "source", "action", "max_ts",
            *[F.coalesce(c, zero).alias(c) for c in ("bytes_read", "lines_read", "rows_inserted", "rows_skipped")],
        )
        wrote = store.write("ingest_audit", folder, audit)
        return wrote if read_files is None else wrote | store.write("import_files", folder, read_files(audited))

    by_date = epoch_date(F.col("reported_at"))
    slow_facts = with_ids(events, moved).withColumn("event_date", epoch_date(F.col("occurred_at")))
    facts = {
        "slow_events": (slow_facts, ("description_id", "occurred_at")),
        "cpu_reports": (reports.withColumn("event_date", by_date), ("reported_at",)),
        "cpu_stats": (stats.withColumn("event_date", by_date), ("description_id", "reported_at")),
    }
    numbers = files.select("file_key", keys.file_no(F.col("file_key")).alias("file_no"))
    jobs = [write_counts]
    for table, (rows, sort_by) in facts.items():
        jobs.append(partial(store.write, table, folder, rows.filter("NOT is_open"), sort_by, by_source))
        jobs.append(partial(store.write, f"open_{table}", folder, rows.filter("is_open").drop("file_key").join(numbers, "file_no")))
    jobs += [
        partial(store.write, "descriptions", folder, new),
        partial(store.write, "quarantine", folder, _quarantine(slow).unionByName(_quarantine(blocks))),
    ]
    wrote = {k: v for one in run_together(jobs) for k, v in one.items()}

    if "descriptions" in wrote and not resolve:
        written_names = store.read_folders("descriptions", [folder])
        if not clashing_names(written_names, known_names).isEmpty():
            raise NamesClash

    # From here on the run's own facts are read, which are few columns and sorted.
    written = {t: store.read_folders(t, [folder] if t in wrote else []) for t in FACTS}
    wrote |= store.write_partials(folder, written["cpu_reports"], written["cpu_stats"], written["slow_events"])
    marks = high_water(written["slow_events"], "occurred_at", ("source", "severity")).unionByName(
        high_water(written["cpu_stats"], "reported_at", ("source",)).withColumn("severity", F.lit(None).cast("string"))
    )
    # One row per configured source and severity.
    return wrote, [[r["source"], r["severity"], r["max_ts"]] for r in marks.collect()]


def _left_open(store: Store, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(reports, statistics, events) read from the open ends of files that have been replaced since."""
    opened = [store.open_rows(t) for t in ("cpu_reports", "cpu_stats", "slow_events")]
    if all(df is None for df in opened):
        return None
    gone = files.filter("action = 'replaced'").select("file_key")
    reports, stats, events = [
        (store.read_folders(f"open_{t}", []).drop("run") if df is None else df).join(gone, "file_key", "left_semi")
        .withColumns({
            "file_no": keys.file_no(F.col("file_key")), "is_open": F.lit(False),
            "offset": F.lit(-1).cast("bigint"), "stat_no": F.lit(1),
        })
        for t, df in zip(("cpu_reports", "cpu_stats", "slow_events"), opened)
    ]
    return reports.drop("event_date"), stats.drop("event_date", "file_key"), events.drop(
        "event_date", "description_id", "file_key", "stat_no"
    )


def rebuild_rollups(store: Store, dates: list | None = None, now: int = 0) -> int:
    """Recomputes all rollups, or those of the given days, from the facts and puts them in place of the runs' parts."""
    for _ in range(MOST_ATTEMPTS):
        number = len(store.committed()) + 1
        folder = store.folder(number)
        kept: dict[str, DataFrame] = {}
        facts = {t: store.closed(t) for t in FACTS}
        if dates is not None:
            facts = {t: df.filter(F.col("event_date").isin(dates)) for t, df in facts.items()}
            kept = {n: store.closed(n).filter(~F.col("event_date").isin(dates)) for n in PARTIALS}
        wrote = store.write_partials(folder, facts["cpu_reports"], facts["cpu_stats"], facts["slow_events"], kept=kept)
        # Also a rollup without rows is replaced.
        wrote = {n: wrote.get(n, {"rows": 0, "first_day": None, "last_day": None, "latest": None}) for n in PARTIALS}
        if store.commit(number, folder, wrote, now, rebuilt=True):
            return number
    raise RuntimeError(f"{MOST_ATTEMPTS} other runs were quicker")


def status_counts(store: Store) -> DataFrame:
    """Row counts of the stored tables for the status report."""
    from perfweave.operators.bounds import row_counts

    return row_counts({t: store.read(t) for t in ("descriptions", *FACTS[1:], FACTS[0])})


def write_result(result: DataFrame, path: str, fmt: str = "json") -> None:
    """Stores a query result for its consumer."""
    result.write.mode("overwrite").format(fmt).save(path)
