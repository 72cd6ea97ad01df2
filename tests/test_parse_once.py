"""A filter on what a parser finds does not have the fields parsed again for each time it names them."""

from perfweave.operators.parse_slow import parse_slow, slow_quarantine, slow_rows

LINES = [
    "[1/2/2024 3:04:05] Execution time: 12 ms - fn - told\r\n", "\n", "server restarted\n",
    "[31/2/2024 3:04:05] Execution time: 12 ms - fn - told\n",
]


def stamps_read(df):
    """How often the optimised plan reads a time stamp."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("d/M/yyyy")


def test_slow_lines(spark):
    lines = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(LINES)], "id long, record binary").repartition(2)
    parsed = parse_slow(lines, "record")
    good, bad = slow_rows(parsed), slow_quarantine(parsed)
    assert stamps_read(good) == 1 and stamps_read(bad) == 1
    assert [(r.id, r.execution_ms, r.description) for r in good.collect()] == [(0, 12, "told")]
    assert sorted((r.id, r.reason) for r in bad.collect()) == [(2, "malformed"), (3, "bad timestamp")]
