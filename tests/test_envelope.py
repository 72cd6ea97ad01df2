"""The window that a result answers, beside its points."""

import pytest
from samples import cpu_block, slow_line, write_logs
from test_ingest import NOW, stamp

from perfweave import EngineConfig
from perfweave.plans.envelope import envelope
from perfweave.plans.ingest import import_logs
from perfweave.plans.store import open_store


def test_envelope_of_a_store(spark, tmp_path):
    store = open_store(spark, str(tmp_path / "s"))
    empty = envelope(store.tables(), "slow", "lua").first()
    assert (empty["source"], empty["range"], empty["start"], empty["end"], empty["bucket_seconds"]) == ("lua", "day", None, None, 60)
    data = write_logs(tmp_path / "d", {"lua_slow.log": slow_line(stamp(NOW - 500)), "dispatcher.log": cpu_block(stamp(NOW - 400))})
    import_logs(spark, data, store, NOW, EngineConfig(import_days=0))
    tables = store.tables()
    assert tuple(envelope(tables, "slow", "lua", range_="hour").first()) == ("lua", "hour", NOW - 4100, NOW - 500, 30)
    assert tuple(envelope(tables, "cpu", end=NOW).first()) == ("dispatcher", "day", NOW - 86400, NOW, 60)
    name = store.read("descriptions").filter("source = 'lua'").first()
    assert tuple(envelope(tables, "slow", description_id=name.description_id).first())[-2:] == (name.description_id, "task")
    assert envelope(tables, "slow", description_id=1).collect() == []
    for wrong in ({"kind": "disk"}, {"kind": "slow", "source": "x"}, {"kind": "cpu", "range_": "year"}, {"kind": "cpu", "end": 0}, {"kind": "slow", "description_id": 0}):
        with pytest.raises(ValueError):
            envelope(tables, **wrong)
