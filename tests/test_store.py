"""The store between runs: commit log, concurrent writers, parts that add up, and plans that read little."""

import glob
from concurrent.futures import ThreadPoolExecutor

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from samples import cpu_block, slow_line, write_logs
from test_ingest import NOW, counts, stamp

from perfweave import EngineConfig
from perfweave.operators import rollups
from perfweave.operators.dedup import SLOW_KEY, accept_slow, unseen
from perfweave.operators.dims import describe, names_of
from perfweave.plans import cpu, slow
from perfweave.plans.commits import PACK, CommitLog
from perfweave.plans.ingest import import_logs
from perfweave.plans.store import open_store

CONFIG = EngineConfig(import_days=0)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def files_read(df):
    """Files that the scans of ``df`` opened."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan
    leaves, total = plan.collectLeaves(), 0
    todo = [leaves.apply(i) for i in range(leaves.size())]
    while todo:
        node = todo.pop()
        if node.nodeName().endswith("QueryStage"):
            inner = node.plan().collectLeaves()
            todo += [inner.apply(i) for i in range(inner.size())]
        elif node.nodeName().startswith("Scan parquet"):
            total += node.metrics().apply("numFiles").value()
    return total


def test_commit_log(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    assert log.records() == []
    for n in range(1, PACK + 3):
        assert log.claim(n, {"who": n})
        assert not CommitLog(spark, str(tmp_path / "log")).claim(n, {"who": "late"})
    assert [r["who"] for r in log.records()] == list(range(1, PACK + 3))
    # A new reader takes the packed file and what follows it.
    (tmp_path / "log" / f"{1:012d}.json").write_text("not read any more")
    assert [r["run"] for r in CommitLog(spark, str(tmp_path / "log")).records()] == list(range(1, PACK + 3))
    assert [r["run"] for r in CommitLog(spark, str(tmp_path / "log"), 3).records()] == [1, 2, 3]
    with pytest.raises(ValueError):
        CommitLog(spark, str(tmp_path / "log"), 3).claim(4, {})


def test_two_writers_lose_nothing(spark, tmp_path):
    """Both begin on an empty store, with rows older than the duplicate horizon and one event in common."""
    old, common = slow_line(stamp(NOW - 20 * 86400)), slow_line(stamp(NOW - 100), name="both")
    dirs = [
        write_logs(tmp_path / "a", {"lua_slow.log": old + common + slow_line(stamp(NOW - 50)), "lua.log": cpu_block(stamp(NOW - 70)) * 2}),
        write_logs(tmp_path / "b", {"sql_slow.log": old * 2, "lua_slow_2026-03-13.log": slow_line(stamp(NOW - 19 * 86400)) + common}),
    ]
    store = open_store(spark, str(tmp_path / "s"))
    with ThreadPoolExecutor(2) as pool:
        runs = [f.result().run_id for f in [pool.submit(import_logs, spark, d, open_store(spark, store.root), NOW, CONFIG) for d in dirs]]
    assert sorted(runs) == [1, 2]
    events = store.read("slow_events").groupBy("source", "occurred_at", "description").count().collect()
    assert {(r.source, r.occurred_at, r.description): r["count"] for r in events} == {
        ("lua", NOW - 20 * 86400, "task"): 1, ("lua", NOW - 100, "both"): 1, ("lua", NOW - 50, "task"): 1,
        ("sql", NOW - 20 * 86400, "task"): 2, ("lua", NOW - 19 * 86400, "task"): 1,
    }
    assert store.state().count() == 4 and counts(store)["cpu_stats"] == 2
    assert not (tmp_path / "s" / "_scratch").exists() or not any((tmp_path / "s" / "_scratch").iterdir())


def same(a, b):
    rows = [
        sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(a.columns)).collect()), key=repr)
        for df in (a, b)
    ]
    assert rows[0] == rows[1]


def test_rollups_equal_raw_after_every_import(spark, tmp_path):
    store, data = open_store(spark, str(tmp_path / "s")), tmp_path / "d"
    t = NOW - 3600
    first = cpu_block(stamp(t), name="one")
    two = f"[{stamp(t + 30)}]\n Time (ms)     Calls     Rel usage %    Real usage % Description\n         5         2       10.00000%        1.25000% early\n"
    more = "         6         3       20.00000%        2.50000% later\n\n"
    steps = [
        {"lua.log": first + two, "lua_slow.log": slow_line(stamp(t)) + slow_line(stamp(t + 1))[:30]},  # caught in mid-write
        {"lua.log": first + two + more, "lua_slow.log": slow_line(stamp(t)) + slow_line(stamp(t + 1)) + slow_line(stamp(t + 2))},
        {"lua.log": cpu_block(stamp(t + 60), name="new file"), "lua_slow.log": slow_line(stamp(t + 3), 7)},  # rotated
        {"lua.log": cpu_block(stamp(t + 60), name="new file") + cpu_block(stamp(t + 90), 30)},
    ]
    stats = [["early", "one"], ["early", "later", "one"], ["early", "later", "new file", "one"], ["early", "fn", "later", "new file", "one"]]
    for files, names in zip(steps, stats):
        write_logs(data, files)
        import_logs(spark, str(data), store, NOW, CONFIG)
        tables = store.tables()
        got = tables.cpu_stats.join(tables.descriptions.select("description_id", "description"), "description_id")
        assert sorted(r.description for r in got.collect()) == names
        raw = rollups.all_rollups(tables.cpu_reports, tables.cpu_stats, tables.slow_events)
        for name, df in raw.items():
            same(df, store.read_rollup(name).drop("event_date"))
    assert counts(store) == {"descriptions": 6, "cpu_reports": 4, "cpu_stats": 5, "slow_events": 4}
    # A file that does not grow is not read again, open end or not.
    assert import_logs(spark, str(data), store, NOW, CONFIG).run_id is None


def test_dedup_plan_reads_little(spark, tmp_path):
    store, data = open_store(spark, str(tmp_path / "s")), tmp_path / "d"
    write_logs(data, {"lua_slow.log": "".join(slow_line(stamp(NOW - 86400 * d), 10 + d) for d in range(6, 0, -1))})
    import_logs(spark, str(data), store, NOW, CONFIG)
    stored, marks = store.closed("slow_events"), store.high_water()
    schema = "source STRING, severity STRING, occurred_at BIGINT, execution_ms BIGINT, description STRING, detail STRING, file_no BIGINT, offset BIGINT"

    def kept(ts):
        rows = spark.createDataFrame([("lua", "slow", t, 11, "task", "go", 1, i) for i, t in enumerate(ts)], schema)
        return accept_slow(rows, stored, marks, True)

    plan = plan_of(kept([NOW]))
    assert "SortAggregate" not in plan and "Sort " not in plan and "HashAggregate" in plan
    assert files_read(kept([NOW, NOW])) == 0 and kept([NOW, NOW]).count() == 2  # all fresh
    overlap = kept([NOW - 3 * 86400, NOW - 3 * 86400])
    assert files_read(overlap) == 1 and overlap.count() == 1  # one day of six
    assert kept([NOW - 86400]).count() == 0  # stored


def test_unseen_keeps_one_and_tells_nulls_apart(spark):
    schema = "a STRING, b STRING, x DOUBLE, place BIGINT, note BIGINT"
    rows = spark.createDataFrame(
        [("p", None, 0.0, 1, 1), ("p", None, -0.0, 2, 2), (None, "p", 1.0, 3, 3), (None, None, 1.0, 4, 4), ("q", "r", float("nan"), 5, 5)], schema
    )
    stored = spark.createDataFrame([(None, None, 1.0), ("q", "r", float("nan"))], "a STRING, b STRING, x DOUBLE")
    got = sorted((r.a or "", r.b or "", abs(r.x)) for r in unseen(rows, stored, ("a", "b", "x"), ("place",)).collect())
    assert got == [("", "p", 1.0), ("p", "", 0.0)]
    assert unseen(rows.select("a", "b", "x"), stored, ("a", "b", "x")).count() == 2
    assert set(SLOW_KEY) <= {*"source severity occurred_at execution_ms description detail".split()}


def test_planning_runs_no_job(spark, tmp_path):
    store, data = open_store(spark, str(tmp_path / "s")), tmp_path / "d"
    write_logs(data, {"lua_slow.log": slow_line(stamp(NOW - 500)), "dispatcher.log": cpu_block(stamp(NOW - 400))})
    import_logs(spark, str(data), store, NOW, CONFIG)
    tables = store.tables()
    assert tables.ends == {"slow_events": NOW - 500, "cpu_reports": NOW - 400, "cpu_stats": NOW - 400}
    assert tables.rolled_sources["slow"] == {"lua"}
    spark.sparkContext.setJobGroup("planning", "planning")
    queries = [slow.overview(tables, "lua"), slow.comparison(tables, "lua"), slow.top_functions(tables, "sql"), cpu.header_overview(tables)]
    assert spark.sparkContext.statusTracker().getJobIdsForGroup("planning") == []
    for q in queries:
        assert "Subquery" not in plan_of(q)
    assert [r.t for r in queries[0].collect()] == [(NOW - 500) // 60 * 60]
    assert slow.overview(tables, "lua", mode="raw").agg(F.sum("event_count")).first()[0] == 1


def test_names_lie_by_id(spark, tmp_path):
    store = open_store(spark, str(tmp_path / "s"))
    names = names_of(spark.range(40_000).selectExpr("'lua' AS source", "concat('task ', id) AS description"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # would fold files as small as these
    try:
        store.commit(1, "a", store.write("descriptions", "a", names), NOW)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    wanted = names.filter("description = 'task 7'").first().description_id
    files = [pq.ParquetFile(f) for f in glob.glob(f"{tmp_path}/s/descriptions/*/*.parquet")]
    ids = [f.metadata.row_group(0).column(0).statistics for f in files if f.metadata.num_rows]
    assert len(ids) > 1 and sum(i.min <= wanted <= i.max for i in ids) == 1
    assert describe(store.tables().descriptions, wanted) == ("lua", "task 7")
    plan = store.tables().descriptions.filter(f"description_id = {wanted}")._jdf.queryExecution().toString()
    assert f"EqualTo(description_id,{wanted})" in plan


def test_names_that_share_an_id_get_their_own(spark, tmp_path, monkeypatch):
    def same(source, description, attempt=0):
        return F.when(source.isNotNull(), F.lit(5 + attempt).cast("bigint"))

    store, config = open_store(spark, str(tmp_path / "s")), EngineConfig(import_days=0)
    data = write_logs(tmp_path / "d", {"lua_slow.log": slow_line(stamp(NOW - 500))})
    monkeypatch.setattr("perfweave.functions.keys.description_id", same)
    import_logs(spark, data, store, NOW, config)
    write_logs(tmp_path / "d", {"lua_slow_2.log": slow_line(stamp(NOW - 400), name="other")})
    import_logs(spark, data, store, NOW, config)
    # Both clash with the first name, then with the second, then with each other.
    write_logs(tmp_path / "d", {
        "lua_slow_3.log": slow_line(stamp(NOW - 300), name="third") + slow_line(stamp(NOW - 290), name="other"),
        "lua.log": cpu_block(stamp(NOW - 200), name="fn") + cpu_block(stamp(NOW - 170), name="other"),
    })
    import_logs(spark, data, store, NOW, config)
    ids = {r.description: r.description_id for r in store.read("descriptions").collect()}
    assert ids == {"task": 5, "other": 6, "fn": 7, "third": 8}
    # Known names keep their ids in later runs.
    write_logs(tmp_path / "d", {"lua_slow_4.log": "".join(slow_line(stamp(NOW - 100), name=n) for n in ids)})
    import_logs(spark, data, store, NOW, config)
    assert {r.description: r.description_id for r in store.read("descriptions").collect()} == ids
    events = store.read("slow_events").groupBy("description", "description_id").count().collect()
    assert {(r.description, r.description_id): r["count"] for r in events} == {
        ("task", 5): 2, ("other", 6): 3, ("third", 8): 2, ("fn", 7): 1,
    }
    stats = store.read("cpu_stats").select("description_id", "reported_at").collect()
    assert {tuple(r) for r in stats} == {(7, NOW - 200), (6, NOW - 170)}
    assert {r.description_id: r.event_count for r in store.read_rollup("slow_function_bucket_agg").groupBy(
        "description_id").agg(F.sum("event_count").alias("event_count")).collect()} == {5: 2, 6: 3, 7: 1, 8: 2}


def test_long_records_import_in_parts(spark, tmp_path, monkeypatch):
    """A report and an untimed file, both far longer than what is read at once."""
    lines = "".join(f"{i:10d}{i:10d}       50.00000%        0.50000% fn {i}\n  more of {i}\n" for i in range(1, 60))
    header = cpu_block(stamp(NOW - 400)).split("\n")
    report = "\n".join([header[0], "Thread: 3 Cpu usage: 41.5% Idle: 58.25% Other: 0.25% Players online: 12", header[1]]) + "\n" + lines + "\n"
    data = write_logs(tmp_path / "d", {
        "lua.log": cpu_block(stamp(NOW - 500)) + report + cpu_block(stamp(NOW - 300)),
        "dispatcher.log": "no report here\n" * 200, "sql_slow.log": "x" * 3000 + "\n" + slow_line(stamp(NOW - 100)),
    })
    config = EngineConfig(import_days=0, range_bytes=1000)
    whole, parts = open_store(spark, str(tmp_path / "whole")), open_store(spark, str(tmp_path / "parts"))
    import_logs(spark, data, whole, NOW, config)
    monkeypatch.setattr("perfweave.sources.ranges.MOST_RECORD_BYTES", 500)
    monkeypatch.setattr("perfweave.sources.ranges.LOOK_AHEAD_BYTES", 128)
    import_logs(spark, data, parts, NOW, config)
    for table in ("cpu_reports", "cpu_stats", "slow_events", "descriptions"):
        same(whole.read(table), parts.read(table))
    assert whole.read("cpu_stats").count() == 61 and whole.read("cpu_reports").count() == 3
    for name in rollups.all_rollups(*[whole.read(t) for t in ("cpu_reports", "cpu_stats", "slow_events")]):
        same(whole.read_rollup(name).drop("event_date"), parts.read_rollup(name).drop("event_date"))
    audits = [s.read("ingest_audit").filter("source <> 'sql'") for s in (whole, parts)]
    same(*audits)
    # A line without a stamp is rejected piece by piece, with all its text.
    kept = parts.read("quarantine").filter("source = 'sql'").collect()
    assert len(kept) == 6 and "".join(r.line for r in sorted(kept, key=lambda r: r.offset)).rstrip("\n") == "x" * 3000
