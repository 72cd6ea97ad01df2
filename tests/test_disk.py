"""What a job leaves on disk while it runs: logs are not kept three times, shuffles end with their query."""

import os
import threading
import time

import pytest
from checks import lives
from perfweave.config import EngineConfig
from perfweave.plans import sample_views as views
from perfweave.plans.ingest import import_logs
from perfweave.plans.store import open_store, shuffles_removed, stage
from perfweave.streaming.ingest import tail_into_store
from pyspark.sql import functions as F
from samples import cpu_block, slow_line, write_logs

SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
CONFIG = EngineConfig(import_days=0)


def _shuffle_files(spark):
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    files = env.blockManager().diskBlockManager().getAllFiles().mkString("\n").splitlines()
    return {f for f in files if os.path.basename(f).startswith("shuffle_")}


def _left(spark, before):
    """New shuffle files that are still there after a while; they are removed behind the query's end."""
    until = time.time() + 10
    while (left := _shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.1)
    return left


def _lines(spark, n=20_000):
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "b.log").otherwise("a.log").alias("file_name"), (F.col("id") * 60).alias("at"), "id",
        F.concat(F.lit("some text that comes again "), "id", F.lit("\n")).alias("text"),
    )


def test_pieces_are_compressed_and_what_sorted_them_is_gone(spark, tmp_path):
    rows, folder = _lines(spark), str(tmp_path / "logs")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    before = _shuffle_files(spark)
    files = views.write_files(rows, folder)
    # The files have not been begun.
    assert not os.path.exists(folder)
    kept = views.pieces_folder(folder)
    pieces = [f"{kept}/{f}" for f in os.listdir(kept) if ".log." in f]
    assert len(pieces) > 20 and sum(map(os.path.getsize, pieces)) < size / 2
    assert not _left(spark, before)
    assert sum(r["rows"] for r in files.collect()) == 20_000
    for name in ("a.log", "b.log"):
        want = [r["text"] for r in rows.filter(F.col("file_name") == name).orderBy("id").collect()]
        assert open(f"{folder}/{name}").read() == "".join(want)


def test_an_import_leaves_no_shuffle_files(spark, tmp_path):
    logs = write_logs(tmp_path / "logs", {
        "lua.log": "".join(cpu_block(f"2/3/2026 9:{m}:0", name=f"fn{m % 7}") for m in range(60)),
        "lua_slow.log": "".join(slow_line(f"2/3/2026 9:{m}:0", detail=f"detail {m}") for m in range(60)),
    })
    before = _shuffle_files(spark)
    store = open_store(spark, str(tmp_path / "store"))
    import_logs(spark, logs, store, 1_800_000_000, CONFIG)
    assert not _left(spark, before)
    assert spark.conf.get(SETTING) == "false"
    tailed = open_store(spark, str(tmp_path / "tailed"))
    before = _shuffle_files(spark)
    tail_into_store(
        spark, logs, tailed, str(tmp_path / "checkpoint"), lambda: 1_800_000_000, CONFIG, finalize=True
    ).awaitTermination()
    assert not _left(spark, before)
    assert [s.read("cpu_stats").count() for s in (store, tailed)] == [60, 60]
    assert [s.read("slow_events").count() for s in (store, tailed)] == [60, 60]


def test_the_setting_comes_back_after_the_last_that_asked(spark):
    inside, leave = threading.Event(), threading.Event()

    def longer():
        with shuffles_removed(spark):
            inside.set()
            leave.wait(60)

    other = threading.Thread(target=longer)
    with shuffles_removed(spark):
        other.start()
        inside.wait(60)
    assert spark.conf.get(SETTING) == "true"
    leave.set()
    other.join()
    assert spark.conf.get(SETTING) == "false"
    with pytest.raises(ValueError), shuffles_removed(spark):
        raise ValueError
    assert spark.conf.get(SETTING) == "false"


def test_a_shuffle_is_made_anew_for_a_second_use(spark):
    with shuffles_removed(spark):
        counts = spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count()
        assert counts.count() == counts.count() == len(counts.collect()) == len(counts.collect()) == 7


def test_staged_text_is_small(spark, tmp_path):
    rows = _lines(spark)
    assert stage(rows, str(tmp_path / "text")).exceptAll(rows).isEmpty()
    assert all(".zstd." in f.name for f in (tmp_path / "text").glob("part-*"))


@pytest.mark.parametrize("name", ["_growing", "_overlapping"])
def test_logs_are_gone_when_all_is_imported(spark, tmp_path, monkeypatch, name):
    def text(spark, _):
        return spark.range(60).select(
            F.lit("click_slow.log").alias("file_name"), (F.col("id") * 43200 + lives.views.TEXT_START).alias("at"), "id",
            F.lit("[1/2/2024 0:0:0] Execution time: 5 ms - a - b\n").alias("text"),
        )

    there = []
    monkeypatch.setattr(lives, "scratch_dir", lambda _: str(tmp_path / "scratch"))
    for made in ("_slow_text", "_cpu_text"):
        monkeypatch.setattr(lives, made, text)
    monkeypatch.setattr(lives, "import_logs", lambda spark, folder, *_: there.append(os.listdir(folder)))
    getattr(lives, name)(spark, "")
    assert len(there) > 1 and all(there)
    assert not (tmp_path / "scratch/logs").exists()


def test_names_are_joined_last(spark, tmp_path):
    """Rows are shuffled by their report without the text of their function's name."""
    logs = write_logs(tmp_path / "logs", {"lua.log": cpu_block("2/3/2026 9:0:0")})
    store = open_store(spark, str(tmp_path / "store"))
    import_logs(spark, logs, store, 1_800_000_000, CONFIG)
    rows = lives._stat_rows(store)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    outer, inner = [x for x in plan.splitlines() if "Join Inner" in x][:2]
    assert "description_id" in outer and "report_id" in inner
    assert [r["description"] for r in rows.collect()] == ["fn"]
