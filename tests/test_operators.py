import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from perfweave import EngineConfig, LogTables
from perfweave.operators.align import align_series, hide_sparse_min, shows_min
from perfweave.operators.dedup import accept_slow, high_water
from perfweave.operators.dims import id_collisions, names_of
from perfweave.operators.rollups import slow_function, slow_overview
from perfweave.plans import slow

SLOW = "source STRING, severity STRING, occurred_at BIGINT, execution_ms BIGINT, description STRING, detail STRING"
POINT = "t BIGINT, event_count BIGINT, min_execution_ms BIGINT"


def test_align(spark):
    series = spark.createDataFrame([(60, 3, 5), (90, 1, 2)], POINT)
    grid = spark.createDataFrame([(30, 9, 1), (60, 9, 1)], POINT)
    assert [tuple(r) for r in align_series(series, grid).collect()] == [(30, None, None), (60, 3, 5)]
    assert align_series(series, grid.limit(0)).collect() == series.collect()
    assert align_series(series.limit(0), grid).count() == 2


def test_sparse_min(spark):
    points = spark.createDataFrame([(0, 2, 5), (30, 3, 7)], POINT)
    assert [r.min_execution_ms for r in hide_sparse_min(points).orderBy("t").collect()] == [None, 7]
    assert shows_min(points).first().show_min
    assert not shows_min(points.filter("t = 0")).first().show_min
    assert not shows_min(points.limit(0)).first().show_min


def brute_force(rows, stored):
    """The rule told row by row."""
    marks, seen, out = {}, set(stored), []
    for r in stored:
        marks[r[:2]] = max(marks.get(r[:2], r[2]), r[2])
    for r in rows:
        if r[:2] in marks and r[2] > marks[r[:2]]:
            out.append(r)
        elif r not in seen:
            seen.add(r)
            out.append(r)
    return Counter(out)


EVENT = st.tuples(
    st.sampled_from(["lua", "sql"]), st.sampled_from(["slow", "very_slow"]), st.integers(0, 4),
    st.integers(0, 1), st.sampled_from(["a", "b"]), st.sampled_from(["", "d"]),
)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(EVENT, max_size=40), st.lists(EVENT, max_size=15))
def test_dedup_rule(spark, rows, stored):
    new, old = spark.createDataFrame(rows, SLOW), spark.createDataFrame(stored, SLOW)
    kept = accept_slow(new, old, high_water(old, "occurred_at", ("source", "severity")), True)
    assert Counter(tuple(r) for r in kept.select(*new.columns).collect()) == brute_force(rows, stored)


def test_hot_key(spark):
    rows = [("lua", "slow", 1, 1, "a", "d")] * 5000 + [("lua", "slow", 1, 2, "a", "d")]
    new, old = spark.createDataFrame(rows, SLOW), spark.createDataFrame(rows[:3000], SLOW)
    kept = accept_slow(new, old, high_water(old, "occurred_at", ("source", "severity")), True)
    assert [r.execution_ms for r in kept.collect()] == [2]
    first = accept_slow(new, old.limit(0), high_water(old.limit(0), "occurred_at", ("source", "severity")), False)
    assert first.count() == 5001


def test_ids(spark):
    rows = spark.createDataFrame([("a", f"f{i % 500}") for i in range(1000)], "source STRING, description STRING")
    names = names_of(rows)
    assert names.count() == 500 and names.filter("description_id <= 0").count() == 0
    assert id_collisions(names).count() == 0
    assert id_collisions(names.selectExpr("7L AS description_id", "source", "description")).first().names == 500


@pytest.mark.parametrize("range_", ["day", "7d", "14d"])
def test_rollup_window_edges(spark, range_):
    """In rollup mode the bucket of the start is out and the bucket of the end is in, whole."""
    rng = random.Random(7)
    end = 1773474017
    config = EngineConfig()
    span = config.ranges[range_]
    rows = [("lua", "slow", end - rng.randrange(-40, span + 40), rng.randrange(99), "f", "d") for _ in range(3000)]
    events = spark.createDataFrame(rows, SLOW).selectExpr("*", "1L AS description_id")
    names = spark.createDataFrame([(1, "lua", "f")], "description_id BIGINT, source STRING, description STRING")
    tables = LogTables(names, slow_events=events, slow_overview_agg=slow_overview(events), slow_function_bucket_agg=slow_function(events))
    b = config.bucket_seconds(range_)
    raw, rolled = Counter(), Counter()
    for r in rows:
        if end - span < r[2] <= end:
            raw[r[2] // b * b] += 1
        grain = r[2] // 30 * 30
        if end - span < grain <= end:
            rolled[grain // b * b] += 1
    for mode, want in (("raw", raw), ("rollup", rolled)):
        got = {r.t: r.event_count for r in slow.overview(tables, "lua", end, range_, mode).collect()}
        assert got == dict(want)
