from perfweave import EngineConfig
from perfweave.operators.resume import resume_plan
from perfweave.schemas import IMPORT_FILES
from perfweave.sources.catalog import classify_files, list_logs, total_log_bytes
from perfweave.sources.ranges import with_fingerprints
from samples import write_logs


def classify(spark, names, sources=("dispatcher", "lua", "sql", "special")):
    df = spark.createDataFrame([(n,) for n in names], "file_key STRING")
    rows = classify_files(df, EngineConfig(sources=sources)).collect()
    return {r.file_key: (r.source, r.type, r.severity, r.is_rolling) for r in rows}


def test_names(spark):
    got = classify(spark, [
        "lua.log", "lua_slow.log", "lua_very_slow.log", "lua_2026-03-12.log", "lua-1.log", "lua_slow_2026.log",
        "luajit_slow.log", "luajit.log", "sql.txt", "other.log", "special_very_slow-2.log", "dispatcher.log.1",
    ])
    assert got == {
        "lua.log": ("lua", "cpu", None, True),
        "lua_slow.log": ("lua", "slow", "slow", True),
        "lua_very_slow.log": ("lua", "very_slow", "very_slow", True),
        "lua_2026-03-12.log": ("lua", "cpu", None, False),
        "lua-1.log": ("lua", "cpu", None, False),
        "lua_slow_2026.log": ("lua", "slow", "slow", False),
        "luajit_slow.log": ("lua", "slow", "slow", False),
        "special_very_slow-2.log": ("special", "very_slow", "very_slow", False),
    }


def test_first_source_wins(spark):
    names = ["ab_slow.log", "ab.log"]
    assert classify(spark, names, ("a", "ab"))["ab_slow.log"][0] == "a"
    assert classify(spark, names, ("a", "ab"))["ab.log"][0] == "ab"
    assert classify(spark, names, ("ab", "a"))["ab_slow.log"] == ("ab", "slow", "slow", True)
    # A source whose own name looks slow: the exact names decide first.
    assert classify(spark, ["x_slow.log"], ("x_slow",))["x_slow.log"][1] == "cpu"


def test_listing(spark, tmp_path):
    folder = write_logs(tmp_path / "d", {"lua.log": "abc\n", "sql_slow.log": "\r\nx\n", "note.txt": "n"})
    write_logs(tmp_path / "d" / "sub", {"sql.log": "deep"})
    files = list_logs(spark, folder, EngineConfig())
    assert {r.file_key: r.file_size for r in files.collect()} == {"lua.log": 4, "sql_slow.log": 4}
    assert total_log_bytes(files).first().total_bytes == 8
    prints = {r.file_key: r.first_line for r in with_fingerprints(files).collect()}
    import hashlib
    assert prints["sql_slow.log"] == hashlib.sha256(b"x").hexdigest()


def test_resume_without_window_reads_rolling_files_whole(spark):
    files = spark.createDataFrame(
        [("lua.log", "/lua.log", 10, 0, "lua", "cpu", None, True, "h")],
        "file_key STRING, path STRING, file_size BIGINT, file_mtime BIGINT, source STRING, type STRING, "
        "severity STRING, is_rolling BOOLEAN, first_line STRING",
    )
    state = spark.createDataFrame([], IMPORT_FILES)
    assert resume_plan(files, state, None).first().action == "full"
    assert resume_plan(files, state, 5).first().action == "seek"
    known = spark.createDataFrame([("lua.log", "/lua.log", 20, 0, 20, None, "h", 1)], IMPORT_FILES)
    row = resume_plan(files, known, 5).first()
    assert (row.action, row.shrunk, row.start_offset) == ("up_to_date", True, 10)
