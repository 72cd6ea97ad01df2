"""The driver's tables written out as logs: no names on the driver, no file sorted by one task."""

import os

from pyspark.sql import functions as F

from perfweave.plans import sample_views as views


def _tables(spark, n=200):
    ids = spark.range(n)
    orders = ids.select(
        F.col("id").alias("o_orderkey"), F.lit("2-HIGH").alias("o_orderpriority"), F.lit(7).alias("o_custkey"),
        F.timestamp_seconds(F.col("id")).alias("o_orderdate"), F.lit(123.45).alias("o_totalprice"),
    )
    items = ids.select(
        F.col("id").alias("l_orderkey"), (F.col("id") % 3).alias("l_partkey"), F.lit(5.0).alias("l_quantity"),
        F.lit(1).alias("l_linenumber"), F.lit(0.07).alias("l_discount"), F.lit(0.0).alias("l_tax"),
    )
    part = spark.range(3).select(F.col("id").alias("p_partkey"), F.lit("part").alias("p_name"))
    return orders, items, part


def test_names_are_not_broadcast(spark):
    plan = views.report_text(*_tables(spark))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [l_partkey" in plan and "BroadcastHashJoin [l_partkey" not in plan


def test_figures_are_written_as_format_string_does(spark):
    values = [None, 0.0, -0.0, 7.000000000000001, 0.000004, -0.000001, 99.999995, 1e20, -3.5, float("nan"), float("inf")]
    rows = spark.createDataFrame([(v, n) for v in values for n in (None, 0, -12, 123456789012)], "v DOUBLE, n BIGINT")
    made = rows.select(
        F.concat(views._padded(F.col("n"), 10), views._padded(views._five_places(F.col("v")), 15), F.lit("%")).alias("made"),
        F.format_string("%10d%15s%%", "n", F.format_string("%.5f", "v")).alias("wanted"),
    )
    assert [r["made"] for r in made.collect()] == [r["wanted"] for r in made.collect()]


def test_a_file_is_written_in_pieces_and_in_order(spark, tmp_path):
    rows = spark.range(400).select(
        F.when(F.col("id") % 4 == 0, "b.log").otherwise("a.log").alias("file_name"),
        ((F.col("id") * 7919) % 400 * 3600).alias("at"), "id",
    ).withColumn("text", F.concat(F.lpad(F.col("at").cast("string"), 9, "0"), F.lit("é\n")))
    want = {
        name: "".join(sorted(r["text"] for r in rows.filter(F.col("file_name") == name).collect())) for name in ("a.log", "b.log")
    }
    folder = str(tmp_path / "logs")
    counts = {r["file_name"]: r["rows"] for r in views.write_files(rows, folder).collect()}
    assert counts == {"a.log": 300, "b.log": 100}
    assert len(os.listdir(views.pieces_folder(folder))) > 17
    views.write_logs(rows, folder)
    assert {f: open(f"{folder}/{f}", encoding="utf8").read() for f in os.listdir(folder)} == want
    assert not os.path.exists(views.pieces_folder(folder))
