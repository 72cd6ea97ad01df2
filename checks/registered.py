"""One entry per query and operator, run over the driver's whole tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfweave.functions.text import clean_text
from perfweave.operators import bounds as bounds_op
from perfweave.operators import rollups
from perfweave.operators.align import hide_sparse_min, shows_min
from perfweave.operators.dedup import CPU_STREAM, SLOW_STREAM, accept_cpu, accept_slow, high_water
from perfweave.operators.dims import id_collisions, names_of, new_names, resolve_ids
from perfweave.operators.filters import keep_dedup_horizon, keep_import_window
from perfweave.operators.parse_cpu import block_reports, block_stats, identified, parse_blocks
from perfweave.operators.parse_slow import parse_slow, slow_quarantine, slow_rows
from perfweave.operators.resume import resume_plan, status_report, upsert_state
from perfweave.plans import cpu, sample_views as views, slow
from perfweave.plans.envelope import envelope
from perfweave.plans.ingest import import_logs, plan_files, status_counts
from perfweave.plans.store import Store, open_store, scratch_dir
from perfweave.sources.catalog import classify_files, list_logs, pending_bytes, total_log_bytes
from perfweave.sources.ranges import cut_ranges, range_count, read_records, with_fingerprints, with_seek_offsets
from perfweave.sources.scan import scan_lines

SLOW_SOURCE = "click"
CPU_SOURCE = "2-HIGH"
# A fixed "now" for runs whose result does not depend on it.
NOW = 1_735_689_600


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places: both engines sum in their own order."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _slow(spark, sf_dir, rollup=False):
    return views.slow_tables(spark, sf_dir, with_rollups=rollup)


def _cpu(spark, sf_dir, rollup=False):
    return views.cpu_tables(spark, sf_dir, with_rollups=rollup)


def _busiest(facts: DataFrame):
    """Id of the function with most rows, as a scalar subquery."""
    top = facts.groupBy("description_id").count().orderBy(F.desc("count"), "description_id").limit(1)
    return top.select("description_id").scalar()


# Read queries

def slow_overview(spark, sf_dir, mode, range_="30d"):
    return rounded(slow.overview(_slow(spark, sf_dir, mode == "rollup"), SLOW_SOURCE, None, range_, mode, views.SLOW_CONFIG))


def slow_top(spark, sf_dir, sort, mode):
    tables = _slow(spark, sf_dir, mode == "rollup")
    return rounded(slow.top_functions(tables, SLOW_SOURCE, None, "30d", sort, 50, mode, views.SLOW_CONFIG))


def slow_series(spark, sf_dir, mode):
    tables = _slow(spark, sf_dir, mode == "rollup")
    return rounded(slow.function_series(
        tables, _busiest(tables.slow_events), SLOW_SOURCE, None, "30d", mode, views.SLOW_CONFIG
    ))


def slow_summary(spark, sf_dir, mode):
    tables = _slow(spark, sf_dir, mode == "rollup")
    return rounded(slow.window_summary(tables, SLOW_SOURCE, None, "30d", mode, views.SLOW_CONFIG))


def slow_comparison(spark, sf_dir, mode):
    tables = _slow(spark, sf_dir, mode == "rollup")
    return rounded(slow.comparison(tables, SLOW_SOURCE, None, "14d", mode, views.SLOW_CONFIG))


def slow_overview_comparison(spark, sf_dir, mode):
    tables = _slow(spark, sf_dir, mode == "rollup")
    one = slow.overview_with_comparison(tables, SLOW_SOURCE, None, "14d", mode, views.SLOW_CONFIG)
    return rounded(one.select(*[c for c in one.columns if c != "points"], F.inline("points")))


def dispatcher_overview(spark, sf_dir, mode, range_="all"):
    return rounded(cpu.header_overview(_cpu(spark, sf_dir, mode == "rollup"), None, None, range_, mode, views.CPU_CONFIG))


def source_usage(spark, sf_dir, mode):
    return rounded(cpu.source_usage(_cpu(spark, sf_dir, mode == "rollup"), CPU_SOURCE, None, "all", mode, views.CPU_CONFIG))


def cpu_top(spark, sf_dir, sort, mode):
    tables = _cpu(spark, sf_dir, mode == "rollup")
    return rounded(cpu.top_functions(tables, CPU_SOURCE, None, "all", sort, 50, mode, views.CPU_CONFIG))


def cpu_series(spark, sf_dir):
    tables = _cpu(spark, sf_dir)
    return rounded(cpu.function_series(tables, _busiest(tables.cpu_stats), CPU_SOURCE, None, "all", views.CPU_CONFIG))


def aligned_series(spark, sf_dir):
    tables = _slow(spark, sf_dir)
    return rounded(slow.aligned_series(
        tables, _busiest(tables.slow_events), SLOW_SOURCE, None, "30d", "raw", views.SLOW_CONFIG
    ))


def cpu_aligned_series(spark, sf_dir):
    tables = _cpu(spark, sf_dir)
    return rounded(cpu.aligned_series(
        tables, _busiest(tables.cpu_stats), CPU_SOURCE, None, "all", "raw", views.CPU_CONFIG
    ))


def sparse_min(spark, sf_dir):
    points = slow.overview(_slow(spark, sf_dir), SLOW_SOURCE, None, "30d", "raw", views.SLOW_CONFIG)
    return hide_sparse_min(points).select(
        "t", "event_count", "min_execution_ms", shows_min(points).scalar().alias("show_min")
    )


def auto_routing(spark, sf_dir):
    """With a rollup at hand ``auto`` answers from it."""
    return rounded(slow.overview(_slow(spark, sf_dir, True), SLOW_SOURCE, None, "7d", "auto", views.SLOW_CONFIG))


def auto_routing_raw(spark, sf_dir):
    """Without one it falls back to the facts."""
    return rounded(slow.overview(_slow(spark, sf_dir), SLOW_SOURCE, None, "7d", "auto", views.SLOW_CONFIG))


def slow_envelope(spark, sf_dir):
    """Source and window of the overview with the default end, and of the busiest function's series."""
    tables = _slow(spark, sf_dir)
    whole = envelope(tables, "slow", SLOW_SOURCE, None, "30d", config=views.SLOW_CONFIG)
    function = envelope(tables, "slow", None, None, "7d", _busiest(tables.slow_events), views.SLOW_CONFIG)
    return whole.unionByName(function, allowMissingColumns=True)


def cpu_envelope(spark, sf_dir):
    return envelope(_cpu(spark, sf_dir), "cpu", CPU_SOURCE, None, "all", config=views.CPU_CONFIG)


def cpu_meta(spark, sf_dir):
    meta = cpu.cpu_meta(_cpu(spark, sf_dir), views.CPU_CONFIG)
    return meta.withColumn("sources", F.array_join("sources", ","))


def slow_meta(spark, sf_dir):
    meta = slow.slow_meta(_slow(spark, sf_dir, True), views.SLOW_CONFIG)
    return meta.withColumn("sources", F.array_join("sources", ","))


def time_bounds(spark, sf_dir):
    slow_facts, reports = _slow(spark, sf_dir).slow_events, _cpu(spark, sf_dir).cpu_reports
    return bounds_op.bounds(slow_facts, "occurred_at").withColumn("fact", F.lit("slow_events")).unionByName(
        bounds_op.bounds(reports, "reported_at").withColumn("fact", F.lit("cpu_reports"))
    )


def table_counts(spark, sf_dir):
    s, c = _slow(spark, sf_dir), _cpu(spark, sf_dir)
    return bounds_op.row_counts({
        "descriptions": c.descriptions, "cpu_reports": c.cpu_reports,
        "cpu_stats": c.cpu_stats, "slow_events": s.slow_events,
    })


def high_waters(spark, sf_dir):
    marks = high_water(_slow(spark, sf_dir).slow_events, "occurred_at", SLOW_STREAM)
    cpu_marks = high_water(_cpu(spark, sf_dir).cpu_reports, "reported_at", CPU_STREAM)
    return marks.unionByName(cpu_marks.withColumn("severity", F.lit("cpu")))


# Rollups

def rollup(spark, sf_dir, name):
    c = _cpu(spark, sf_dir)
    frame = rollups.all_rollups(c.cpu_reports, c.cpu_stats, _slow(spark, sf_dir).slow_events)[name]
    return rounded(frame)


# Log text: the tables written out as logs, read back by the parsers

_logs: dict[tuple[str, str], str] = {}
_stores: dict[tuple[str, str], Store] = {}


def _log_dir(spark: SparkSession, sf_dir: str) -> str:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _logs:
        _logs[key] = views.render_logs(spark, sf_dir, f"{scratch_dir(spark)}/logs")
    return _logs[key]


def _imported(spark: SparkSession, sf_dir: str) -> Store:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        store = open_store(spark, f"{scratch_dir(spark)}/store")
        import_logs(spark, _log_dir(spark, sf_dir), store, NOW, views.TEXT_CONFIG)
        _stores[key] = store
    return _stores[key]


def _files(spark, sf_dir):
    return list_logs(spark, _log_dir(spark, sf_dir), views.TEXT_CONFIG)


def _records(spark, sf_dir, blocks):
    wanted = "type = 'cpu'" if blocks else "type <> 'cpu'"
    files = _files(spark, sf_dir).filter(wanted).withColumn("start_offset", F.lit(0).cast("bigint"))
    size = views.TEXT_CONFIG.range_bytes
    return read_records(cut_ranges(files, size, range_count(files, size)), blocks)


def parse_slow_text(spark, sf_dir):
    lines = scan_lines(spark, _log_dir(spark, sf_dir)).filter(F.col("file_key").contains("slow"))
    rows = classify_files(slow_rows(parse_slow(lines)), views.TEXT_CONFIG)
    return rows.select("source", "severity", "occurred_at", "execution_ms", "description", "detail")


def parse_slow_ranges(spark, sf_dir):
    rows = slow_rows(parse_slow(_records(spark, sf_dir, False), "record"))
    return rows.select("source", "severity", "occurred_at", "execution_ms", "description", "detail")


def rejected_lines(spark, sf_dir):
    bad = slow_quarantine(parse_slow(_records(spark, sf_dir, False), "record"))
    return bad.groupBy("file_key", "reason", F.rtrim(F.col("record").cast("string"), F.lit("\r\n")).alias("line")).agg(
        F.count(F.lit(1)).alias("n")
    )


def parse_reports(spark, sf_dir):
    return rounded(block_reports(parse_blocks(_records(spark, sf_dir, True))).select(
        "source", "reported_at", "thread_id", "cpu_usage", "idle", "other", "players_online"
    ))


def parse_stats(spark, sf_dir):
    return rounded(block_stats(identified(parse_blocks(_records(spark, sf_dir, True)))).select(
        "source", "reported_at", "time_ms", "calls", "rel_usage", "real_usage", "description"
    ))


def sanitize_text(spark, sf_dir):
    """A stray Latin-1 byte survives in storage and becomes U+FFFD when read for display."""
    name = F.concat(F.lit("fn_").cast("binary"), F.unhex(F.lit("B6")), F.col("user_id").cast("string").cast("binary"))
    rows = views.read(spark, sf_dir, "events").select("event_id", name.cast("string").alias("raw"))
    return rows.select(
        "event_id", clean_text(F.col("raw")).alias("description"),
        F.octet_length("raw").cast("bigint").alias("stored_bytes"),
    )


# Catalog, fingerprint, resume

def file_names(spark, sf_dir):
    """Names of all shapes from the event table."""
    tails = [
        ".log", "_slow.log", "_very_slow.log", "_2024-01-01.log", "-old.log",
        "x.log", "_very_slow_3.log", "_slow-7.log", ".txt",
    ]
    tail = F.element_at(F.array(*[F.lit(t) for t in tails]), (F.col("event_id") % len(tails) + 1).cast("int"))
    return views.read(spark, sf_dir, "events").select("event_id", F.concat("event_type", tail).alias("file_key"))


def classified_files(spark, sf_dir):
    return classify_files(file_names(spark, sf_dir), views.SLOW_CONFIG)


def catalog(spark, sf_dir):
    return _files(spark, sf_dir).select("file_key", "source", "type", "severity", "is_rolling")


def fingerprints(spark, sf_dir):
    return with_fingerprints(_files(spark, sf_dir)).select("file_key", "first_line")


def log_bytes(spark, sf_dir):
    """Bytes in all logs, and bytes an import would read before and after importing them."""
    files = _files(spark, sf_dir)
    fresh = plan_files(spark, _log_dir(spark, sf_dir), Store(spark, scratch_dir(spark)).read("import_files"), NOW, views.TEXT_CONFIG)
    done = plan_files(spark, _log_dir(spark, sf_dir), _imported(spark, sf_dir).read_latest("import_files"), NOW, views.TEXT_CONFIG)
    total = total_log_bytes(files)
    return total.select(
        "total_bytes",
        pending_bytes(fresh).scalar().alias("pending_before"),
        pending_bytes(done).scalar().alias("pending_after"),
    )


def seek_offsets(spark, sf_dir):
    """First line inside a window, per time-sorted CPU log."""
    files = _files(spark, sf_dir).filter("type = 'cpu'").select("file_key", "path", "file_size")
    sought = with_seek_offsets(files, SEEK_CUTOFF, "UTC")
    blocks = parse_blocks(_records(spark, sf_dir, True)).select("file_key", "offset", "reported_at")
    at = F.col("seek_offset") == F.col("offset")
    # Reported as the time found there, since byte positions are not in the tables.
    found = sought.join(blocks, ["file_key"]).filter(at).select("file_key", "reported_at")
    return found


SEEK_CUTOFF = views.TEXT_START + 10 * 86400


def _file_frames(spark, sf_dir):
    """Files and import state derived from events: one file per source and day."""
    day = F.expr("occurred_at div 86400")
    rows = views.slow_view(views.read(spark, sf_dir, "events"))
    files = rows.groupBy("source", day.alias("day")).agg(
        F.sum("execution_ms").alias("file_size"), F.max("occurred_at").alias("max_at")
    ).select(
        F.concat("source", F.lit("_slow_"), F.col("day").cast("string"), F.lit(".log")).alias("file_key"),
        F.when(F.col("day") % 11 == 0, 0).otherwise(F.col("file_size")).alias("file_size"),
        (F.col("day") % 2 == 0).alias("is_rolling"),
        F.concat(F.lit("h"), F.col("day").cast("string")).alias("first_line"),
        "day", "max_at",
    )
    kind = F.col("day") % 6
    state = files.filter(kind != 0).select(
        "file_key",
        F.concat(F.lit("/logs/"), "file_key").alias("path"),
        "file_size",
        F.lit(0).cast("bigint").alias("file_mtime"),
        F.when(kind == 1, F.col("file_size")).when(kind == 2, F.expr("file_size div 2"))
        .when(kind == 3, F.col("file_size") + 5).otherwise(0).alias("byte_offset"),
        F.col("max_at").alias("max_occurred_at"),
        F.when(kind == 5, "other").otherwise(F.col("first_line")).alias("first_line"),
        F.lit(100).cast("bigint").alias("updated_at"),
    )
    return files, state


def resume_decisions(spark, sf_dir):
    files, state = _file_frames(spark, sf_dir)
    plan = resume_plan(files.drop("max_at"), state, 1)
    return plan.select("file_key", "action", "start_offset", "shrunk")


def state_upsert(spark, sf_dir):
    files, state = _file_frames(spark, sf_dir)
    updates = files.filter("day % 3 = 0").select(
        "file_key", F.concat(F.lit("/logs/"), "file_key").alias("path"), "file_size",
        F.lit(1).cast("bigint").alias("file_mtime"), F.col("file_size").alias("byte_offset"),
        F.col("max_at").alias("max_occurred_at"), "first_line", F.lit(200).cast("bigint").alias("updated_at"),
    )
    return status_report(upsert_state(state, updates))


# Filters, de-duplication, names

def window_filters(spark, sf_dir):
    """A row's fate under the import window (20 days) and the duplicate horizon (7 days)."""
    rows = _slow(spark, sf_dir).slow_events
    now = rows.agg(F.max("occurred_at")).scalar()
    first = keep_import_window(rows, "occurred_at", now - 20 * 86400)
    again = keep_dedup_horizon(first, "occurred_at", now - 7 * 86400, True)
    keys = ["source", "severity"]
    n = F.count(F.lit(1)).alias("n")
    return first.groupBy(*keys).agg(n).withColumn("run", F.lit("first")).unionByName(
        again.groupBy(*keys).agg(n).withColumn("run", F.lit("incremental"))
    )


def _middle(facts: DataFrame, ts: str):
    return facts.agg(F.expr(f"(min({ts}) + max({ts})) div 2")).scalar()


def dedup_slow(spark, sf_dir):
    events = views.read(spark, sf_dir, "events")
    rows = views.slow_view(events).drop("description_id")
    cut = _middle(rows, "occurred_at")
    stored = views.slow_view(events.filter("event_id % 4 <> 0")).drop("description_id").filter(F.col("occurred_at") <= cut)
    late = rows.filter(F.col("occurred_at") > cut - 3 * 86400)
    twice = late.unionByName(late.filter("execution_ms % 3 = 0"))
    kept = accept_slow(twice, stored, high_water(stored, "occurred_at", SLOW_STREAM), True)
    return kept.select("source", "severity", "occurred_at", "execution_ms", "description", "detail")


def dedup_cpu(spark, sf_dir):
    tables = _cpu(spark, sf_dir)
    rows = rollups.timed_stats(tables.cpu_stats, tables.cpu_reports)
    cut = _middle(tables.cpu_reports, "reported_at")
    stored = rows.filter((F.col("report_id") % 4 != 0) & (F.col("reported_at") <= cut))
    late = rows.filter(F.col("reported_at") > cut - 100 * 86400)
    twice = late.unionByName(late.filter("time_ms % 3 = 0"))
    kept = accept_cpu(twice, stored, high_water(stored, "reported_at", CPU_STREAM), True)
    return rounded(kept.select("source", "reported_at", "description_id", "time_ms", "calls", "rel_usage", "real_usage"))


def dim_upsert(spark, sf_dir):
    rows = views.slow_view(views.read(spark, sf_dir, "events"))
    known = names_of(rows.filter("description_id % 2 = 0"))
    return new_names(rows, known).select("source", "description")


def dim_lookup(spark, sf_dir):
    """Rows per name, resolved through the dimension; unknown names stay NULL."""
    rows = views.slow_view(views.read(spark, sf_dir, "events")).withColumnRenamed("description_id", "own_id")
    known = rows.filter("own_id % 2 = 0").groupBy("source", "description").agg(F.min("own_id").alias("description_id"))
    return resolve_ids(rows, known).groupBy("source", "description_id").agg(F.count(F.lit(1)).alias("n"))


def dim_collisions(spark, sf_dir):
    """No two names share a computed id."""
    names = names_of(views.slow_view(views.read(spark, sf_dir, "events")))
    return id_collisions(names).agg(F.count(F.lit(1)).alias("collisions"))


# End to end

def import_slow_events(spark, sf_dir):
    return _imported(spark, sf_dir).read("slow_events").select(
        "source", "severity", "occurred_at", "execution_ms", "description", "detail"
    )


def import_cpu_stats(spark, sf_dir):
    store = _imported(spark, sf_dir)
    names = store.read("descriptions").select("description_id", "description")
    reports = store.read("cpu_reports").select("report_id", "cpu_usage")
    # Names come last: rows are shuffled without them.
    return rounded(store.read("cpu_stats").join(reports, "report_id").join(names, "description_id").select(
        "source", "reported_at", "description", "time_ms", "calls", "rel_usage", "real_usage", "cpu_usage", "players_online"
    ))


def import_counts(spark, sf_dir):
    return status_counts(_imported(spark, sf_dir))


def import_top(spark, sf_dir):
    """A read query on the imported store, through its rollup."""
    top = cpu.top_functions(
        _imported(spark, sf_dir).tables(), "high", None, "14d", "total", 50, "rollup", views.TEXT_CONFIG
    )
    # Ids are hashes here; costs in rank order do not depend on how ties fall.
    return top.select("total_time_ms").orderBy(F.desc("total_time_ms"))


def ingest_audit(spark, sf_dir):
    return _imported(spark, sf_dir).read_latest("ingest_audit").select(
        "file_key", "action", "lines_read", "rows_inserted", "rows_skipped", "max_ts"
    )


def import_status(spark, sf_dir):
    state = _imported(spark, sf_dir).read_latest("import_files")
    return status_report(state).select("file_key", "max_timestamp", (F.col("byte_offset") == F.col("file_size")).alias("read_whole"))


def all_queries():
    from checks.lives import life_queries
    from checks.streams import stream_queries

    named = {
        "slow_overview_raw": partial(slow_overview, mode="raw"),
        "slow_overview_rollup": partial(slow_overview, mode="rollup"),
        "slow_overview_rollup_14d": partial(slow_overview, mode="rollup", range_="14d"),
        "slow_series_raw": partial(slow_series, mode="raw"),
        "slow_series_rollup": partial(slow_series, mode="rollup"),
        "slow_window_summary": partial(slow_summary, mode="raw"),
        "slow_window_summary_rollup": partial(slow_summary, mode="rollup"),
        "slow_comparison": partial(slow_comparison, mode="raw"),
        "slow_comparison_rollup": partial(slow_comparison, mode="rollup"),
        "slow_overview_comparison": partial(slow_overview_comparison, mode="raw"),
        "slow_overview_comparison_rollup": partial(slow_overview_comparison, mode="rollup"),
        "dispatcher_overview_raw": partial(dispatcher_overview, mode="raw"),
        "dispatcher_overview_rollup": partial(dispatcher_overview, mode="rollup"),
        "dispatcher_overview_rollup_7d": partial(dispatcher_overview, mode="rollup", range_="7d"),
        "source_usage_raw": partial(source_usage, mode="raw"),
        "source_usage_rollup": partial(source_usage, mode="rollup"),
        "cpu_series": cpu_series,
        "aligned_series": aligned_series,
        "cpu_aligned_series": cpu_aligned_series,
        "sparse_min": sparse_min,
        "auto_routing": auto_routing,
        "auto_routing_raw": auto_routing_raw,
        "slow_envelope": slow_envelope,
        "cpu_envelope": cpu_envelope,
        "cpu_meta": cpu_meta,
        "slow_meta": slow_meta,
        "time_bounds": time_bounds,
        "row_counts": table_counts,
        "high_water": high_waters,
        "parse_slow": parse_slow_text,
        "parse_slow_ranges": parse_slow_ranges,
        "rejected_lines": rejected_lines,
        "parse_reports": parse_reports,
        "parse_stats": parse_stats,
        "sanitize_text": sanitize_text,
        "classify_files": classified_files,
        "catalog": catalog,
        "fingerprint": fingerprints,
        "log_bytes": log_bytes,
        "seek_offsets": seek_offsets,
        "resume_plan": resume_decisions,
        "state_upsert": state_upsert,
        "window_filters": window_filters,
        "dedup_slow": dedup_slow,
        "dedup_cpu": dedup_cpu,
        "dim_upsert": dim_upsert,
        "dim_lookup": dim_lookup,
        "dim_collisions": dim_collisions,
        "import_slow_events": import_slow_events,
        "import_cpu_stats": import_cpu_stats,
        "import_counts": import_counts,
        "import_top_rollup": import_top,
        "ingest_audit": ingest_audit,
        "import_status": import_status,
    }
    for sort in ("count", "max", "avg", "total"):
        named[f"slow_top_{sort}"] = partial(slow_top, sort=sort, mode="raw")
        named[f"slow_top_rollup_{sort}"] = partial(slow_top, sort=sort, mode="rollup")
    for sort in ("max", "avg", "total"):
        named[f"cpu_top_{sort}"] = partial(cpu_top, sort=sort, mode="raw")
        named[f"cpu_top_rollup_{sort}"] = partial(cpu_top, sort=sort, mode="rollup")
    for short, name in {
        "cpu_overview": "cpu_overview_agg", "source_usage": "cpu_source_usage_agg",
        "cpu_function": "cpu_function_bucket_agg", "slow_overview": "slow_overview_agg",
        "slow_function": "slow_function_bucket_agg",
    }.items():
        named[f"rollup_{short}"] = partial(rollup, name=name)
    return {**named, **stream_queries(), **life_queries()}
