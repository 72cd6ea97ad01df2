"""Statistics are found and taken apart in one pass; a filter does not take them apart again."""

from perfweave.operators.parse_cpu import block_stats, explode_stats, identified, parse_blocks

HEAD = "[1/2/2024 3:04:05]\nThread: 1 Cpu usage: 1.5% Idle: 98.4% Other: 0.1% Players online: 7\n Time (ms) Calls Rel Real Description\n"


def blocks(spark, *bodies):
    rows = [("lua.log", "lua", None, i, (HEAD + b).encode("latin-1")) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "file_key string, source string, severity string, offset long, record binary").repartition(2)


def test_figures_are_not_read_by_a_filter(spark):
    stats = explode_stats(identified(parse_blocks(blocks(spark, " 1 2 3.5% 4.5% a\n")).drop("record")))
    plan = stats._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.split("\n") if "Filter (" in line]
    assert filters and not any("split(" in f or "regexp" in f for f in filters)


def test_nameless_statistics(spark):
    bodies = (
        " 1 2 3.5% 4.5% a\n 5 6 7% 8% \n more\n 9 10 1.2.3% 4% b\n\nover\n",
        " 1 2 3% 4%  \n 5 6 7% 8% c\n 9 9 9% 9% \t",
        " 1 2 3% 4% \n",
        " 1 2 3% 4%d\n 1 2 3% 4% \xf6\xe4 x % \r\n",
        " 99999999999999999999 2 .% 4% e\n",
        "",
    )
    parsed = parse_blocks(blocks(spark, *bodies))
    assert {r.offset: (r.status, r.n_stats) for r in parsed.collect()} == {
        0: ("ok", 2), 1: ("ok", 1), 2: ("empty", 0), 3: ("ok", 1), 4: ("ok", 1), 5: ("empty", 0),
    }
    found = {(r.offset, r.stat_no): (r.time_ms, r.calls, r.rel_usage, r.real_usage, bytes(r.name)) for r in block_stats(
        identified(parsed)).selectExpr("*", "cast(description as binary) as name").collect()}
    assert found == {
        (0, 1): (1, 2, 3.5, 4.5, b"a"), (0, 3): (9, 10, 1.2, 4.0, b"b\nover"),
        (1, 2): (5, 6, 7.0, 8.0, b"c"),
        (3, 1): (1, 2, 3.0, 4.0, "\xf6\xe4 x %".encode("latin-1")),
        (4, 1): (9223372036854775807, 2, 0.0, 4.0, b"e"),
    }
