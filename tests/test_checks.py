"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from checks.compare import check, connect
from perfweave.config import EngineConfig

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    verdict, _, rows = check(spark, con, SF, name)
    assert verdict in ("ok", "no sql"), verdict
    assert rows > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["t", "event_count", "min_execution_ms", "max_execution_ms", "avg_execution_ms"]
    assert df.count() > 0


def test_effective_buckets():
    config = EngineConfig()
    got = {r: config.bucket_seconds(r) for r in config.ranges}
    assert got == {"hour": 30, "day": 60, "7d": 404, "14d": 807, "30d": 1800}
    assert all(config.ranges[r] / b <= config.max_points for r, b in got.items())
    with pytest.raises(ValueError):
        EngineConfig(import_days=-1)
    assert config.clamp_limit(0) == 1 and config.clamp_limit(999) == 50 and config.clamp_limit(None) == 50
