import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F
from samples import cpu_block, slow_line, write_logs

from perfweave import EngineConfig
from perfweave.operators.dedup import SLOW_KEY
from perfweave.plans.ingest import status_counts
from perfweave.plans.store import open_store
from perfweave.sources.tail import _TailReader, planned_position, tail_logs
from perfweave.streaming.ingest import store_batch, tail_into_store
from perfweave.streaming.rollups import dedup_fresh_stream, dedup_stream, rocksdb_state, slow_overview_stream, with_event_time

NOW = 1773500000


def stamp(ts):
    t = datetime.fromtimestamp(ts, timezone.utc)
    return f"{t.day}/{t.month}/{t.year} {t.hour}:{t.minute}:{t.second}"


def drain(spark, df, folder):
    q = (
        df.writeStream.format("parquet").option("checkpointLocation", f"{folder}/c")
        .trigger(availableNow=True).start(f"{folder}/sink")
    )
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/sink")


def test_tail_reads_each_record_once(spark, tmp_path):
    config = EngineConfig(range_bytes=100)
    t = NOW - 1000
    blocks = [cpu_block(stamp(t + 30 * i), name=f"fn{i}") for i in range(6)]
    lines = [slow_line(stamp(t + i), 10 + i) for i in range(6)]
    data = str(tmp_path / "d")

    def write(cpu, slow):
        write_logs(tmp_path / "d", {"lua.log": cpu, "lua_slow.log": slow, "other.txt": "x", "empty_slow.log": ""})

    def seen(finalize=False):
        rows = drain(spark, tail_logs(spark, data, config, finalize, None), str(tmp_path / "q")).collect()
        return sorted((r.type, r.offset, bytes(r.record).decode()) for r in rows)

    def want(cpu, slow):
        out, at = [], 0
        for b in cpu:
            out.append(("cpu", at, b))
            at += len(b)
        at = 0
        for s in slow:
            out.append(("slow", at, s))
            at += len(s)
        return sorted(out)

    # The last block is still open, the last line incomplete.
    write("".join(blocks[:3]), "".join(lines[:2]) + lines[2][:9])
    assert seen() == want(blocks[:2], lines[:2])
    assert seen() == want(blocks[:2], lines[:2])  # nothing new
    write("".join(blocks[:5]), "".join(lines[:4]))
    assert seen() == want(blocks[:4], lines[:4])
    assert seen(finalize=True) == want(blocks[:5], lines[:4])
    # Replaced by a file with another first line: read from its start.
    fresh = [slow_line(stamp(t + 500), 99), lines[5]]
    write("".join(blocks[:5]), "".join(fresh))
    got = seen(finalize=True)
    assert sorted(got) == sorted(want(blocks[:5], lines[:4]) + want([], fresh))


def test_tail_byte_budget(spark, tmp_path):
    config = EngineConfig(range_bytes=150)
    lines = [slow_line(stamp(NOW - 1000 + i), 10 + i) for i in range(40)]
    data = write_logs(tmp_path / "d", {"lua_slow.log": "".join(lines)})
    stream = tail_logs(spark, data, config, max_bytes=500, checkpoint=str(tmp_path / "c"))
    q = (
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c"))
        .start(str(tmp_path / "sink"))
    )
    q.processAllAvailable()
    batches = [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]
    q.stop()
    rows = spark.read.schema(stream.schema).parquet(str(tmp_path / "sink")).collect()
    assert sorted(bytes(r.record).decode() for r in rows) == sorted(lines)
    assert len(batches) > 3 and max(batches) <= 500 // len(lines[0]) + 1


def test_byte_budget_over_all_files_and_restarts(spark, tmp_path):
    lines = [slow_line(stamp(NOW - 1000 + i), 10 + i) for i in range(40)]
    names = ["lua_slow.log", "lua_slow b.log", "sql_slow.log"]
    long_line = slow_line(stamp(NOW), 7, name="n" * 3000)
    data = write_logs(tmp_path / "d", {n: "".join(lines) for n in names} | {"click_slow.log": long_line + lines[0]})
    options = {"path": data, "maxBytesPerBatch": "1000", "checkpoint": str(tmp_path / "p")}
    (tmp_path / "p" / "offsets").mkdir(parents=True)
    position, records, steps = {}, [], []
    while True:
        reader = _TailReader(options)  # a new one each time, as after a restart
        reader.turn = len(steps)
        after = reader.latestOffset()
        if after == position:
            break
        assert all(after[n]["at"] >= position[n]["at"] for n in position)
        steps.append(sum(v["at"] - position.get(n, {"at": 0})["at"] for n, v in after.items()))
        for part in reader.partitions(position, after):
            for batch in reader.read(part):
                records += [(r["file_key"], r["offset"], r["record"]) for r in batch.to_pylist()]
        position = after
        (tmp_path / "p" / "offsets" / str(len(steps))).write_text(f"v1\n{{}}\n{json.dumps(position)}")
    assert sorted(r[2].decode() for r in records) == sorted(lines * 3 + [long_line, lines[0]])
    assert len(set(records)) == len(records)
    assert sorted(steps)[-1] == len(long_line) and sorted(steps)[-2] <= 1000
    with pytest.raises(ValueError):
        tail_logs(spark, data, EngineConfig(), max_bytes=10)


def test_tail_drops_ranges_before_the_window(spark, tmp_path):
    lines = [slow_line(stamp(NOW - 5000 + i)) for i in range(100)]
    data = write_logs(tmp_path / "d", {"lua_slow.log": "".join(lines)})
    config = EngineConfig(range_bytes=200)
    cutoff = NOW - 5000 + 90
    rows = drain(spark, tail_logs(spark, data, config, True, cutoff), str(tmp_path / "q")).collect()
    texts = {bytes(r.record).decode() for r in rows}
    assert set(lines[90:]) <= texts and len(texts) < 20


def test_tail_rejects_ambiguous_sources(spark):
    with pytest.raises(ValueError):
        tail_logs(spark, "/nowhere", EngineConfig(sources=("very_slow_thing",)))


def test_continuous_import(spark, tmp_path):
    t = NOW - 1000
    config = EngineConfig()
    store = open_store(spark, str(tmp_path / "s"))
    data = write_logs(tmp_path / "d", {
        "lua.log": cpu_block(stamp(t)) + cpu_block(stamp(t + 30)), "lua_slow.log": slow_line(stamp(t)),
    })

    def run(**more):
        tail_into_store(spark, data, store, str(tmp_path / "c"), lambda: NOW, config, **more).awaitTermination()
        return {r["table_name"]: r["row_count"] for r in status_counts(store).collect()}

    assert run()["cpu_stats"] == 1  # the last report is still open
    with open(f"{data}/lua.log", "a") as f:
        f.write(cpu_block(stamp(t + 60)))
    with open(f"{data}/lua_slow.log", "a") as f:
        f.write(slow_line(stamp(t + 5)) + "junk\n")
    got = run(finalize=True)
    assert (got["cpu_reports"], got["cpu_stats"], got["slow_events"]) == (3, 3, 2)
    assert store.read("quarantine").count() == 1
    assert store.read_rollup("cpu_overview_agg").agg(F.sum("sample_count")).first()[0] == 3
    # A batch that is delivered again changes nothing.
    raw = spark.createDataFrame(
        [("lua_slow.log", 0, slow_line(stamp(t + 9)).encode(), "lua", "slow", "slow", True)],
        "file_key STRING, offset BIGINT, record BINARY, source STRING, type STRING, severity STRING, is_rolling BOOLEAN",
    )
    store_batch(raw, 77, store, "again", NOW, config)
    store_batch(raw, 77, store, "again", NOW, config)
    assert store.tables().slow_events.count() == 3


def test_watermarked_streams(spark, tmp_path):
    schema = "source STRING, severity STRING, occurred_at BIGINT, execution_ms BIGINT, description STRING, detail STRING"
    rows = [("lua", "slow", NOW + i // 2, 10 + i // 2, "f", "d") for i in range(200)]  # each twice
    rows.append(("lua", "slow", NOW + 100_000, 1, "end", ""))
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = with_event_time(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "occurred_at")
    once = drain(spark, dedup_stream(stream, SLOW_KEY).select(*SLOW_KEY), str(tmp_path / "a"))
    assert once.count() == 101
    points = drain(spark, slow_overview_stream(stream, "1 minute"), str(tmp_path / "b")).collect()
    assert sum(p.event_count for p in points) == 200
    assert all(p.bucket_time % 30 == 0 for p in points)


def test_two_checkpoints_into_one_store(spark, tmp_path):
    store = open_store(spark, str(tmp_path / "s"))
    for name, at in (("one", 1773400000), ("two", 1773400100)):
        stamp = datetime.fromtimestamp(at, timezone.utc)
        line = slow_line(f"{stamp.day}/{stamp.month}/{stamp.year} {stamp.hour}:{stamp.minute}:{stamp.second}", name=name)
        data = write_logs(tmp_path / name, {"lua_slow.log": line, "lua_slow copy.log": ""})
        tail_into_store(spark, data, store, str(tmp_path / f"checkpoint {name}"), lambda: 1773500000, finalize=True).awaitTermination()
    assert {r.description for r in store.tables().descriptions.collect()} == {"one", "two"}
    assert store.tables().slow_events.count() == 2


def test_limit_switched_on_for_an_old_checkpoint(spark, tmp_path):
    lines = [slow_line(stamp(NOW - 3000 + i), 10 + i) for i in range(120)]
    data = write_logs(tmp_path / "d", {"lua_slow.log": "".join(lines[:60])})
    store, checkpoint = open_store(spark, str(tmp_path / "s")), str(tmp_path / "c")
    tail_into_store(spark, data, store, checkpoint, lambda: NOW).awaitTermination()
    before = planned_position(checkpoint)["lua_slow.log"]["at"]
    assert before == len("".join(lines[:60]))
    with open(f"{data}/lua_slow.log", "a") as f:
        f.write("".join(lines[60:]))
    tail_into_store(spark, data, store, checkpoint, lambda: NOW, max_bytes=len(lines[0]) * 25)
    assert store.tables().slow_events.count() == 120
    assert len(store.committed()) == 4  # three steps of 25 lines at most
    audit = store.read("ingest_audit").agg(F.sum("bytes_read"), F.sum("rows_inserted")).first()
    assert tuple(audit) == (len("".join(lines)), 120)


def test_rewritten_file_with_the_same_first_line(spark, tmp_path):
    first = slow_line(stamp(NOW - 9000), 5)
    lives = [[first] + [slow_line(stamp(NOW - 8000 + 1000 * k + i), 10 + i, name=f"life{k}") for i in range(n)] for k, n in enumerate((80, 30, 200))]
    data, seen = tmp_path / "d", []
    for life in lives:  # longer, shorter and longer again than what was read before
        write_logs(data, {"lua_slow.log": "".join(life)})
        rows = drain(spark, tail_logs(spark, str(data), EngineConfig(), True, None), str(tmp_path / "q")).collect()
        seen += life
        assert sorted(bytes(r.record).decode() for r in rows) == sorted(seen)
    # Grown past the old position before anyone looked.
    late = [first] + [slow_line(stamp(NOW - 2000 + i), 10 + i, name="late") for i in range(400)]
    write_logs(data, {"lua_slow.log": "".join(late)})
    rows = drain(spark, tail_logs(spark, str(data), EngineConfig(), True, None), str(tmp_path / "q")).collect()
    assert sorted(bytes(r.record).decode() for r in rows) == sorted(seen + late)


def test_fresh_rows_are_exempt_and_state_is_hashes(spark, tmp_path):
    schema = "source STRING, severity STRING, occurred_at BIGINT, execution_ms BIGINT, description STRING, detail STRING"
    old = [("lua", "slow", NOW + i // 3, 1, "f" * 1000, None) for i in range(30)]  # each three times
    new = [("lua", "slow", NOW + 100 + i // 2, 1, "f", "d") for i in range(20)]  # each twice
    other = [("sql", "slow", NOW + 100, 1, None, "f"), ("sql", "slow", NOW + 100, 1, "f", None)] * 2
    spark.createDataFrame(old + new + other, schema).write.parquet(str(tmp_path / "in"))
    stream = with_event_time(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "occurred_at")
    marks = spark.createDataFrame([("lua", "slow", NOW + 50)], "source STRING, severity STRING, max_ts BIGINT")
    with rocksdb_state(spark):
        kept = drain(spark, dedup_fresh_stream(stream, marks, SLOW_KEY, "occurred_at", ("source", "severity")).select(*SLOW_KEY), str(tmp_path / "a"))
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert kept.count() == 10 + 20 + 2
    state = spark.read.format("statestore").load(str(tmp_path / "a" / "c"))
    assert sorted(state.schema["key"].dataType.names) == ["_h1", "_h2"] and state.count() == 12
