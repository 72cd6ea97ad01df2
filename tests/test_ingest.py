from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F
from samples import FILES, MULTI_LINE_NAME, cpu_block, slow_line, write_logs

from perfweave import EngineConfig
from perfweave.plans import cpu, slow
from perfweave.plans.ingest import import_logs, rebuild_rollups, status_counts
from perfweave.plans.store import open_store

NOW = 1773500000
CONFIG = EngineConfig()


def counts(store):
    return {r["table_name"]: r["row_count"] for r in status_counts(store).collect()}


def stamp(ts):
    t = datetime.fromtimestamp(ts, timezone.utc)
    return f"{t.day}/{t.month}/{t.year} {t.hour}:{t.minute}:{t.second}"


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("loaded")
    data = write_logs(root / "data")
    store = open_store(spark, str(root / "store"))
    run = import_logs(spark, data, store, NOW, CONFIG)
    assert run.files_read == 4
    return data, store


def test_golden_counts(loaded):
    assert counts(loaded[1]) == {"descriptions": 8, "cpu_reports": 5, "cpu_stats": 8, "slow_events": 6}


def test_golden_reports(loaded):
    rows = loaded[1].read("cpu_reports").orderBy("source", "reported_at").collect()
    got = [(r.source, r.reported_at, r.thread_id, r.cpu_usage, r.idle, r.other, r.players_online) for r in rows]
    assert got == [
        ("dispatcher", 1772442724, 3, 41.5, 58.25, 0.25, 12),
        ("dispatcher", 1772442754, 3, 62.75, 37.0, 0.25, 15),
        ("dispatcher", 1772445669, 4, 8.0, 91.5, 0.5, 9),
        ("lua", 1772442760, None, None, None, None, None),
        ("lua", 1772442790, None, None, None, None, None),
    ]


def test_golden_stats(loaded):
    tables = loaded[1].tables()
    rows = (
        tables.cpu_stats.join(tables.descriptions.drop("source"), "description_id")
        .orderBy("source", "reported_at", F.desc("time_ms"))
        .collect()
    )
    got = [(r.source, r.reported_at, r.time_ms, r.calls, r.rel_usage, r.real_usage, r.description) for r in rows]
    assert got == [
        ("dispatcher", 1772442724, 640, 20, 80.5, 33.4, "tick(queue)"),
        ("dispatcher", 1772442754, 900, 45, 50.25, 31.5, "tick(queue)"),
        ("dispatcher", 1772442754, 400, 9, 22.5, 14.125, "flush(pages)"),
        ("dispatcher", 1772442754, 7, 70, 0.5, 0.25, "ping"),
        ("dispatcher", 1772445669, 55, 5, 100.0, 2.5, "flush(pages)"),
        ("lua", 1772442760, 88, 4, 60.0, 4.4, "jobs/mail.lua:send"),
        ("lua", 1772442760, 21, 2, 15.0, 1.1, MULTI_LINE_NAME),
        ("lua", 1772442790, 5, 1, 100.0, 0.25, "jobs/mail.lua:send"),
    ]


def test_golden_rollups(loaded):
    t = loaded[1].tables()
    assert t.cpu_overview_agg.count() == 5
    usage = {(r.source, r.bucket_time): (round(r.avg_report_real_usage, 9), r.report_count) for r in t.cpu_source_usage_agg.collect()}
    assert usage == {
        ("dispatcher", 1772442720): (33.4, 1), ("dispatcher", 1772442750): (45.875, 1), ("dispatcher", 1772445660): (2.5, 1),
        ("lua", 1772442750): (5.5, 1), ("lua", 1772442780): (0.25, 1),
    }
    hours = sorted((r.source, r.bucket_time) for r in t.cpu_function_bucket_agg.collect())
    assert hours == [("dispatcher", 1772442000)] * 3 + [("dispatcher", 1772445600)] + [("lua", 1772442000)] * 2
    events = {
        (r.source, r.bucket_time): (r.event_count, r.min_execution_ms, r.max_execution_ms, r.sum_execution_ms)
        for r in t.slow_overview_agg.collect()
    }
    assert events == {
        ("dispatcher", 1772442720): (1, 24, 24, 24),
        ("dispatcher", 1772444400): (1, 130, 130, 130),
        ("special", 1772575500): (2, 18, 51, 69),
        ("special", 1772578680): (1, 33, 33, 33),
        ("special", 1772578830): (1, 27, 27, 27),
    }
    special = sorted((r.bucket_time, r.event_count, r.sum_execution_ms) for r in t.slow_function_bucket_agg.filter("source = 'special'").collect())
    assert special == [(1772575200, 1, 51), (1772575200, 2, 51), (1772578800, 1, 27)]


@pytest.mark.parametrize("mode", ["raw", "rollup", "auto"])
def test_golden_slow_overview(loaded, mode):
    tables = loaded[1].tables()
    rows = slow.overview(tables, "special", 1772578831, "day", mode).collect()
    assert [(r.t, r.event_count, r.min_execution_ms, r.max_execution_ms, r.avg_execution_ms) for r in rows] == [
        (1772575500, 2, 18, 51, 34.5),
        (1772578680, 1, 33, 33, 33.0),
        (1772578800, 1, 27, 27, 27.0),
    ]
    c = slow.comparison(tables, "special", 1772578831, "day", mode).first()
    assert (c.current_event_count, c.current_max_execution_ms, c.current_avg_execution_ms, c.current_unique_functions) == (4, 51, 32.25, 2)
    assert (c.previous_event_count, c.previous_max_execution_ms, c.previous_avg_execution_ms, c.previous_unique_functions) == (0, None, None, 0)
    assert (c.event_count_pct, c.max_execution_ms_pct, c.avg_execution_ms_pct) == (None, None, None)


def test_default_end_and_meta(loaded):
    tables = loaded[1].tables()
    rows = cpu.overview(tables, range_="hour", mode="raw").collect()
    assert [(r.t, r.cpu_usage, r.players_online) for r in rows] == [
        (1772442720, 41.5, 12.0), (1772442750, 62.75, 15.0), (1772445660, 8.0, 9.0),
    ]
    meta = cpu.cpu_meta(tables).first()
    assert (meta.earliest_reported_at, meta.latest_reported_at, meta.default_end) == (1772442724, 1772445669, 1772445669)
    assert (meta.cpu_stats_rows, meta.slow_events_rows) == (8, 6)
    assert list(meta.sources) == ["dispatcher", "lua", "sql", "special"]
    assert slow.slow_meta(tables).first().latest_occurred_at == 1772578831


def test_series_and_errors(loaded):
    tables = loaded[1].tables()
    top = cpu.top_functions(tables, "lua", 1772442790, "day", "total", mode="raw").collect()
    assert [r.total_time_ms for r in top] == [93, 21]
    series = cpu.function_series(tables, top[0].description_id, end=1772442790).collect()
    assert [(r.t, r.time_ms, r.calls, r.players_online) for r in series] == [
        (1772442720, 88.0, 4.0, None), (1772442780, 5.0, 1.0, None),
    ]
    aligned = cpu.aligned_series(tables, top[1].description_id, "lua", 1772442790, "hour", "raw").collect()
    assert [(r.t, r.time_ms) for r in aligned] == [(1772442750, 21.0), (1772442780, None)]
    for call in (
        lambda: cpu.function_series(tables, 123456789),
        lambda: cpu.function_series(tables, 0),
        lambda: cpu.overview(tables, "nope", 1, "day"),
        lambda: cpu.overview(tables, "lua", 1, "year"),
        lambda: cpu.overview(tables, "lua", 0, "day"),
        lambda: cpu.top_functions(tables, "lua", 1, "day", "count"),
        lambda: slow.top_functions(tables, "lua", 1, "day", "median"),
        lambda: slow.function_series(tables, 123456789),
    ):
        with pytest.raises(ValueError):
            call()


def test_reimport_changes_nothing(spark, loaded):
    data, store = loaded
    before = counts(store)
    assert import_logs(spark, data, store, NOW, CONFIG).run_id is None
    assert counts(store) == before


def test_rollup_equals_raw_on_aligned_window(loaded):
    tables = loaded[1].tables()
    end = 1772575200 + 3600 - 1
    for sort in ("count", "max", "avg", "total"):
        raw = slow.top_functions(tables, "special", end, "day", sort, mode="raw").collect()
        assert raw == slow.top_functions(tables, "special", end, "day", sort, mode="rollup").collect()


def test_rebuild_is_stable(loaded):
    store = loaded[1]
    before = sorted(map(tuple, store.read_rollup("cpu_function_bucket_agg").collect()))
    rebuild_rollups(store)
    assert sorted(map(tuple, store.read_rollup("cpu_function_bucket_agg").collect())) == before
    rebuild_rollups(store, [r.event_date for r in store.read("cpu_reports").select("event_date").distinct().collect()])
    assert sorted(map(tuple, store.read_rollup("cpu_function_bucket_agg").collect())) == before


def test_import_window_and_skips(spark, tmp_path):
    old, new = NOW - 40 * 86400, NOW - 86400
    data = write_logs(tmp_path / "d", {
        "lua_slow_daily.log": slow_line(stamp(old)) + slow_line(stamp(new)),
        "sql_slow.log": slow_line(stamp(old)),
        "sql.log": cpu_block(stamp(old)) + cpu_block(stamp(new)),
        "special.log": "",
    })
    store = open_store(spark, str(tmp_path / "s"))
    assert import_logs(spark, data, store, NOW, CONFIG).files_read == 2
    assert counts(store) == {"descriptions": 2, "cpu_reports": 1, "cpu_stats": 1, "slow_events": 1}
    state = {r.file_key: r for r in store.read_latest("import_files").collect()}
    assert set(state) == {"lua_slow_daily.log", "sql.log"}
    audit = {r.file_key: r for r in store.read_latest("ingest_audit").collect()}
    assert (audit["lua_slow_daily.log"].rows_inserted, audit["lua_slow_daily.log"].rows_skipped) == (1, 1)
    assert audit["sql.log"].action == "seek" and audit["sql.log"].lines_read == 4


def test_append_replace_and_dedup(spark, tmp_path):
    t = NOW - 3600
    config = EngineConfig(import_days=0)
    dup = slow_line(stamp(t))
    write_logs(tmp_path / "d", {"lua_slow.log": dup + dup, "lua.log": cpu_block(stamp(t))})
    data = str(tmp_path / "d")
    store = open_store(spark, str(tmp_path / "s"))
    import_logs(spark, data, store, NOW, config)
    assert counts(store)["slow_events"] == 2  # a first load keeps repeats

    # Appended: one stored already, one old but new (twice), one past the mark (twice), one too old.
    older, later, ancient = slow_line(stamp(t - 60)), slow_line(stamp(t + 60)), slow_line(stamp(NOW - 9 * 86400))
    with open(f"{data}/lua_slow.log", "a") as f:
        f.write(dup + older + older + later + later + ancient)
    with open(f"{data}/lua.log", "a") as f:
        f.write(cpu_block(stamp(t)) + cpu_block(stamp(t - 30)) + cpu_block(stamp(t + 30)))
    run = import_logs(spark, data, store, NOW, config)
    assert run.run_id == 2
    assert counts(store)["slow_events"] == 2 + 1 + 2
    assert counts(store)["cpu_reports"] == 3 and counts(store)["cpu_stats"] == 3
    audit = {r.file_key: r for r in store.read_latest("ingest_audit").collect()}
    assert audit["lua_slow.log"].lines_read == 6 and audit["lua_slow.log"].action == "append"
    assert store.tables().slow_overview_agg.agg(F.sum("event_count")).first()[0] == 5

    # Replaced: another first line, so it is read from the start again.
    write_logs(tmp_path / "d", {"lua_slow.log": slow_line(stamp(t + 120), 77) + dup})
    import_logs(spark, data, store, NOW, config)
    assert counts(store)["slow_events"] == 6
    assert store.tables().slow_overview_agg.agg(F.sum("event_count")).first()[0] == 6


def test_open_end_is_held_back(spark, tmp_path):
    t = NOW - 3600
    full = cpu_block(stamp(t)) + cpu_block(stamp(t + 30), name="second")
    cut = len(full) - 20
    write_logs(tmp_path / "d", {"lua.log": full[:cut], "lua_slow.log": slow_line(stamp(t)) + "[2/3/20"})
    data, store = str(tmp_path / "d"), open_store(spark, str(tmp_path / "s"))
    import_logs(spark, data, store, NOW, CONFIG, finalize=False)
    assert counts(store)["cpu_reports"] == 1 and counts(store)["slow_events"] == 1
    write_logs(tmp_path / "d", {"lua.log": full, "lua_slow.log": slow_line(stamp(t)) + slow_line(stamp(t + 1))})
    import_logs(spark, data, store, NOW, CONFIG)
    names = {r.description for r in store.read("descriptions").collect()}
    assert names == {"fn", "second", "task"}
    assert counts(store)["cpu_stats"] == 2 and counts(store)["slow_events"] == 2
    assert store.read("quarantine").count() == 0


def test_separate_files_and_rolled_days(spark, tmp_path):
    t = NOW - 3600
    data = write_logs(tmp_path / "d", {
        "sql_slow_2026-03-13.log": slow_line(stamp(t)),
        "sql_slow_2026-03-14.log": slow_line(stamp(t + 1)),
    })
    store = open_store(spark, str(tmp_path / "s"))
    import_logs(spark, data, store, NOW, CONFIG)
    assert counts(store)["slow_events"] == 2
    assert store.read_latest("import_files").count() == 2


def test_dead_run_is_invisible(spark, tmp_path):
    data = write_logs(tmp_path / "d", FILES)
    store = open_store(spark, str(tmp_path / "s"))
    # Facts of a run that never got recorded.
    other = open_store(spark, str(tmp_path / "o"))
    import_logs(spark, data, other, NOW, CONFIG)
    store.write_run("slow_events", 1, other.read("slow_events"))
    assert store.tables().slow_events.count() == 0
    import_logs(spark, data, store, NOW, CONFIG)
    assert counts(store)["slow_events"] == 6
