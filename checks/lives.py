"""Entries for stores and streams whose logs grow, are rotated and overlap between imports."""

from __future__ import annotations

from dataclasses import replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfweave.operators.dedup import SLOW_KEY, SLOW_STREAM, high_water
from perfweave.plans import sample_views as views
from perfweave.plans.ingest import import_logs
from perfweave.plans.store import Store, delete, open_store, scratch_dir, stage
from perfweave.schemas import ROLLUPS
from perfweave.sources.catalog import list_logs, total_log_bytes
from perfweave.streaming import rollups as s
from perfweave.streaming.ingest import tail_into_store

# A fixed "now" far behind the data, and a duplicate horizon that covers all of it.
NOW = 1_735_689_600
CONFIG = replace(views.TEXT_CONFIG, dedup_days=4000)
DAY = 86400
# Where the first import stops, in the middle of the logs.
CUT = views.TEXT_START + 15 * DAY

_made: dict[tuple, object] = {}


def _once(spark: SparkSession, sf_dir: str, make):
    key = (spark.sparkContext.applicationId, sf_dir, make.__name__)
    if key not in _made:
        _made[key] = make(spark, sf_dir)
    return _made[key]


def _slow_text(spark, sf_dir) -> DataFrame:
    return views.slow_text(views.read(spark, sf_dir, "events"))


def _cpu_text(spark, sf_dir) -> DataFrame:
    return views.report_text(*[views.read(spark, sf_dir, t) for t in ("orders", "lineitem", "part")])


def _write(rows: DataFrame, folder: str) -> None:
    views.write_logs(rows, folder)


def _half_written(text: DataFrame) -> DataFrame:
    """The logs up to the cut, with half of each file's next record behind it."""
    late = text.filter(F.col("at") > CUT)
    first = late.groupBy("file_name").agg(F.min(F.struct("at", "id")).alias("_f")).select("file_name", "_f.at", "_f.id")
    torn = late.join(first, ["file_name", "at", "id"]).withColumn("text", F.expr("left(text, length(text) div 2)"))
    return text.filter(F.col("at") <= CUT).unionByName(torn.select(*text.columns))


def _growing(spark, sf_dir) -> Store:
    """Imported in mid-write, then when the files are complete."""
    d = scratch_dir(spark)
    text = stage(_slow_text(spark, sf_dir).unionByName(_cpu_text(spark, sf_dir)), f"{d}/text")
    store = open_store(spark, f"{d}/store")
    _write(_half_written(text), f"{d}/logs")
    import_logs(spark, f"{d}/logs", store, NOW, CONFIG)
    _write(text, f"{d}/logs")
    delete(spark, f"{d}/text")
    import_logs(spark, f"{d}/logs", store, NOW, CONFIG)
    delete(spark, f"{d}/logs")
    return store


def _overlapping(spark, sf_dir) -> str:
    """Three imports: a part of the logs; daily files that overlap it; rolling files rotated since."""
    d = scratch_dir(spark)
    slow, reports = stage(_slow_text(spark, sf_dir), f"{d}/slow"), stage(_cpu_text(spark, sf_dir), f"{d}/reports")
    store, at = open_store(spark, f"{d}/store"), F.col("at")
    daily = slow.filter((at > CUT - 3 * DAY) & (at <= CUT + 8 * DAY)).withColumn(
        "file_name", F.replace("file_name", F.lit(".log"), F.lit("_2024-01-31.log"))
    )
    steps = (
        slow.filter((at <= CUT) & (F.col("id") % 4 != 0)).unionByName(reports.filter(at <= CUT)),
        daily.unionByName(daily.filter("id % 3 = 0")),
        slow.filter(at > CUT + 6 * DAY).unionByName(reports.filter(at > CUT)),
    )
    for rows in steps:
        _write(rows, f"{d}/logs")
        import_logs(spark, f"{d}/logs", store, NOW, CONFIG)
    for made in ("slow", "reports", "logs"):
        delete(spark, f"{d}/{made}")
    return store.root


def _slow_rows(store: Store) -> DataFrame:
    return store.read("slow_events").select("source", "severity", "occurred_at", "execution_ms", "description", "detail")


def _stat_rows(store: Store) -> DataFrame:
    names = store.read("descriptions").select("description_id", "description")
    reports = store.read("cpu_reports").select("report_id", "cpu_usage")
    # Names come last: rows are shuffled without them.
    rows = store.read("cpu_stats").join(reports, "report_id").join(names, "description_id").select(
        "source", "reported_at", "description", "time_ms", "calls", "rel_usage", "real_usage", "cpu_usage", "players_online"
    )
    return rows.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


def growing(spark, sf_dir):
    return _slow_rows(_once(spark, sf_dir, _growing))


def growing_stats(spark, sf_dir):
    return _stat_rows(_once(spark, sf_dir, _growing))


def stored_rollup(spark, sf_dir, name):
    """A rollup merged from the parts of several imports, with names for ids."""
    store = _once(spark, sf_dir, _growing)
    rows = store.read_rollup(name).drop("event_date")
    if "description_id" in rows.columns:
        rows = rows.join(store.read("descriptions").select("description_id", "description"), "description_id").drop("description_id")
    return rows.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


def appended(spark, sf_dir):
    """As the first of the growing imports left it, without what was open then."""
    root = _once(spark, sf_dir, _growing).root
    first = open_store(spark, root, as_of=1)
    return first.closed("slow_events").select(*SLOW_KEY)


def overlap(spark, sf_dir):
    return _slow_rows(open_store(spark, _once(spark, sf_dir, _overlapping), as_of=2))


def replaced(spark, sf_dir):
    return _slow_rows(open_store(spark, _once(spark, sf_dir, _overlapping)))


def replaced_stats(spark, sf_dir):
    return _stat_rows(open_store(spark, _once(spark, sf_dir, _overlapping)))


# Streams

def _capped(spark, sf_dir) -> Store:
    """Tailed without a limit in mid-write, then in three steps when the files are complete."""
    d = scratch_dir(spark)
    text = stage(_slow_text(spark, sf_dir).unionByName(_cpu_text(spark, sf_dir)), f"{d}/text")
    store = open_store(spark, f"{d}/store")

    def tail(**more) -> None:
        tail_into_store(spark, f"{d}/logs", store, f"{d}/checkpoint", lambda: NOW, CONFIG, **more).awaitTermination()

    _write(_half_written(text), f"{d}/logs")
    tail()
    _write(text, f"{d}/logs")
    delete(spark, f"{d}/text")
    size = total_log_bytes(list_logs(spark, f"{d}/logs", CONFIG)).first()["total_bytes"]
    tail(finalize=True, max_bytes=size // 4)
    delete(spark, f"{d}/logs")
    return store


def _rewritten(spark, sf_dir) -> Store:
    """Tailed to the cut, then over files that were written anew behind the same first record."""
    d = scratch_dir(spark)
    text = _slow_text(spark, sf_dir)
    store = open_store(spark, f"{d}/store")
    first = text.groupBy("file_name").agg(F.min(F.struct("at", "id", "text")).alias("_f")).select("file_name", "_f.*")
    for rows in (text.filter(F.col("at") <= CUT), text.filter(F.col("at") > CUT).unionByName(first)):
        _write(rows, f"{d}/logs")
        tail_into_store(spark, f"{d}/logs", store, f"{d}/checkpoint", lambda: NOW, CONFIG).awaitTermination()
    return store


def tail_capped(spark, sf_dir):
    return _slow_rows(_once(spark, sf_dir, _capped))


def tail_capped_stats(spark, sf_dir):
    return _stat_rows(_once(spark, sf_dir, _capped))


def tail_replaced(spark, sf_dir):
    return _slow_rows(_once(spark, sf_dir, _rewritten))


def dedup_fresh(spark, sf_dir):
    """Every event arrives twice; past the middle of the month both copies stay."""
    from checks.streams import _drain, _stream

    rows = views.slow_view(views.read(spark, sf_dir, "events"))
    marks = high_water(rows.filter(F.col("occurred_at") <= CUT), "occurred_at", SLOW_STREAM)
    twice = s.with_event_time(
        views.slow_view(_stream(spark, sf_dir, "events").unionByName(_stream(spark, sf_dir, "events"))), "occurred_at"
    )
    with s.rocksdb_state(spark):
        kept = s.dedup_fresh_stream(twice, marks, SLOW_KEY, "occurred_at", SLOW_STREAM, "60 days")
        return _drain(kept.select(*SLOW_KEY), scratch_dir(spark))


def life_queries():
    named = {
        "import_growing": growing,
        "import_growing_stats": growing_stats,
        "import_append": appended,
        "import_overlap": overlap,
        "import_replaced": replaced,
        "import_replaced_stats": replaced_stats,
        "stream_tail_capped": tail_capped,
        "stream_tail_capped_stats": tail_capped_stats,
        "stream_tail_replaced": tail_replaced,
        "stream_dedup_fresh": dedup_fresh,
    }
    short = {
        "cpu_overview": "cpu_overview_agg", "source_usage": "cpu_source_usage_agg", "cpu_function": "cpu_function_bucket_agg",
        "slow_overview": "slow_overview_agg", "slow_function": "slow_function_bucket_agg",
    }
    assert set(short.values()) == set(ROLLUPS)
    return named | {f"import_rollup_{k}": partial(stored_rollup, name=v) for k, v in short.items()}


_COLUMNS = "source, severity, occurred_at, execution_ms, description, detail"


def _accepted(name: str, before: str, late: str) -> str:
    """CTEs of an import: ``before`` is stored, of ``late`` what is fresh is kept whole, the rest once and if new."""
    return f"""
{name}_mark AS (SELECT source, severity, max(occurred_at) AS mark FROM {before} GROUP BY 1, 2),
{name}_late AS (SELECT l.*, mark FROM ({late}) l LEFT JOIN {name}_mark USING (source, severity)),
{name} AS (
  SELECT {_COLUMNS} FROM {before}
  UNION ALL SELECT {_COLUMNS} FROM {name}_late WHERE occurred_at > mark
  UNION ALL (SELECT {_COLUMNS} FROM {name}_late WHERE mark IS NULL OR occurred_at <= mark
    EXCEPT SELECT {_COLUMNS} FROM {before}))"""


def life_sql():
    from checks import oracles as o

    text = [o._SLOW, o._REPORTS, o._STATS, o._TEXT_EVENTS, o._TEXT_REPORTS]
    whole = o._with(*text) + f"SELECT {_COLUMNS} FROM text_slow"
    stats = o._with(*text) + """
SELECT source, reported_at, description, time_ms, calls, rel_usage, real_usage, cpu_usage, players_online FROM text_stats"""
    base = f"""
part AS (SELECT * FROM text_slow WHERE event_id % 4 <> 0 AND occurred_at <= {CUT})"""
    daily = f"SELECT * FROM text_slow WHERE occurred_at > {CUT - 3 * DAY} AND occurred_at <= {CUT + 8 * DAY}"
    second = _accepted("second", "first_run", f"{daily} UNION ALL {daily} AND event_id % 3 = 0")
    third = _accepted("third", "second", f"SELECT * FROM text_slow WHERE occurred_at > {CUT + 6 * DAY}")
    base = base.replace("part AS", "first_run AS")
    half_hour = """
SELECT source, occurred_at // {g} * {g} AS bucket_time, {more} count(*) AS event_count, min(execution_ms) AS min_execution_ms,
  max(execution_ms) AS max_execution_ms, CAST(sum(execution_ms) AS BIGINT) AS sum_execution_ms FROM text_slow GROUP BY ALL"""
    with_stats = "(SELECT DISTINCT report_id, source, reported_at, cpu_usage, players_online FROM text_stats)"
    return {
        "import_growing": whole,
        "import_growing_stats": stats,
        "import_append": whole + f" WHERE occurred_at <= {CUT}",
        "import_overlap": o._with(*text, base, second) + f"SELECT {_COLUMNS} FROM second",
        "import_replaced": o._with(*text, base, second, third) + f"SELECT {_COLUMNS} FROM third",
        "import_replaced_stats": stats,
        "stream_tail_capped": whole,
        "stream_tail_capped_stats": stats,
        "stream_tail_replaced": whole,
        "stream_dedup_fresh": o._with(o._SLOW).rstrip() + f""",
mark AS (SELECT source, severity, max(occurred_at) AS mark FROM slow WHERE occurred_at <= {CUT} GROUP BY 1, 2),
marked AS (SELECT slow.*, mark FROM slow LEFT JOIN mark USING (source, severity))
SELECT {_COLUMNS} FROM marked, range(2) WHERE occurred_at > mark
UNION ALL (SELECT DISTINCT {_COLUMNS} FROM marked WHERE mark IS NULL OR occurred_at <= mark)""",
        "import_rollup_cpu_overview": o._with(*text) + f"""
SELECT source, reported_at // 30 * 30 AS bucket_time, round(avg(cpu_usage), 6) AS avg_cpu_usage,
  round(avg(players_online), 6) AS avg_players_online, count(*) AS sample_count,
  count(cpu_usage) AS cpu_usage_samples, count(players_online) AS players_online_samples FROM {with_stats} GROUP BY 1, 2""",
        "import_rollup_source_usage": o._with(*text) + """
SELECT source, reported_at // 30 * 30 AS bucket_time, round(avg(total), 6) AS avg_report_real_usage, count(*) AS report_count
FROM (SELECT report_id, source, reported_at, sum(real_usage) AS total FROM text_stats GROUP BY ALL) GROUP BY 1, 2""",
        "import_rollup_cpu_function": o._with(*text) + """
SELECT source, reported_at // 3600 * 3600 AS bucket_time, description, round(max(real_usage), 6) AS max_real_usage,
  round(sum(real_usage), 6) AS sum_real_usage, CAST(sum(time_ms) AS BIGINT) AS sum_time_ms,
  CAST(sum(calls) AS BIGINT) AS sum_calls, count(*) AS sample_count FROM text_stats GROUP BY 1, 2, 3""",
        "import_rollup_slow_overview": o._with(*text) + half_hour.format(g=30, more=""),
        "import_rollup_slow_function": o._with(*text) + half_hour.format(g=3600, more="description,"),
    }
