"""The cutoff of the tail never costs a daily file its rows."""

from samples import slow_line, write_logs
from test_streams import NOW, drain, stamp

from perfweave import EngineConfig
from perfweave.sources.tail import tail_logs


def test_unsorted_daily_file_keeps_recent_rows(spark, tmp_path):
    old, recent = [[slow_line(stamp(NOW - age - i), 10 + i) for i in range(6)] for age in (90 * 86400, 1000)]
    # A daily file whose recent rows come first, and a rolling file in order.
    data = write_logs(tmp_path / "d", {"lua_slow_2026-03-14.log": "".join(recent + old), "sql_slow.log": "".join(old + recent)})
    stream = tail_logs(spark, data, EngineConfig(range_bytes=100), finalize=True, cutoff=NOW - 30 * 86400)
    got = {}
    for r in drain(spark, stream, str(tmp_path / "q")).collect():
        got.setdefault(r.file_key, set()).add(bytes(r.record).decode())
    assert got["lua_slow_2026-03-14.log"] == {*recent, *old}
    # Of the rolling file old ranges are skipped still.
    assert set(recent) <= got["sql_slow.log"] < {*recent, *old}
