"""The text of growing and rotated logs is made once, however often files are written of it."""

import pytest
from pyspark.sql import functions as F

from checks import lives


@pytest.mark.parametrize("name", ["_growing", "_overlapping"])
def test_text_is_made_once(spark, tmp_path, monkeypatch, name):
    made = str(tmp_path / "made")
    spark.range(60).select(
        F.lit("click_slow.log").alias("file_name"), (F.col("id") * 43200 + lives.views.TEXT_START).alias("at"), "id",
        F.concat(F.lit("line "), "id", F.lit("\n")).alias("text"),
    ).write.parquet(made)
    read = []

    def write(rows, folder):
        assert rows.count() > 0
        read.extend(rows.inputFiles())

    monkeypatch.setattr(lives, "scratch_dir", lambda _: str(tmp_path / "scratch"))
    for text in ("_slow_text", "_cpu_text"):
        monkeypatch.setattr(lives, text, lambda spark, _: spark.read.parquet(made))
    monkeypatch.setattr(lives, "_write", write)
    monkeypatch.setattr(lives, "import_logs", lambda *_: None)
    getattr(lives, name)(spark, "")
    assert read and not [f for f in read if "/made/" in f]
    assert not list(tmp_path.glob("scratch/text")) + list(tmp_path.glob("scratch/slow")) + list(tmp_path.glob("scratch/reports"))
