"""Streaming entries: run to the end of the data, then read the sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfweave.operators.dedup import SLOW_KEY
from perfweave.operators.rollups import timed_stats
from perfweave.plans import sample_views as views
from perfweave.plans.store import open_store, scratch_dir
from perfweave.streaming import rollups as s
from perfweave.streaming.ingest import tail_into_store

_DELAY = "1 hour"


def _stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    schema = views.read(spark, sf_dir, table).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def _closed(stream: DataFrame, rows: DataFrame, ts: str, folder: str) -> DataFrame:
    """``stream`` with one row far past its end, whose bucket stays open while all others close."""
    end = rows.orderBy(F.desc(ts)).limit(1).withColumn(ts, F.col(ts) + 1000 * 86400)
    end.write.parquet(folder)
    closing = stream.sparkSession.readStream.schema(end.schema).parquet(folder)
    return s.with_event_time(stream.unionByName(closing), ts)


def _drain(out: DataFrame, folder: str) -> DataFrame:
    query = (
        out.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{folder}/sink")
    )
    query.awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(f"{folder}/sink")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def stream_overview(spark, sf_dir):
    d = scratch_dir(spark)
    rows = views.slow_view(views.read(spark, sf_dir, "events"))
    events = _closed(views.slow_view(_stream(spark, sf_dir, "events")), rows, "occurred_at", f"{d}/end")
    return _drain(s.slow_overview_stream(events, _DELAY), d)


def stream_function(spark, sf_dir):
    d = scratch_dir(spark)
    rows = views.slow_view(views.read(spark, sf_dir, "events"))
    events = _closed(views.slow_view(_stream(spark, sf_dir, "events")), rows, "occurred_at", f"{d}/end")
    return _drain(s.slow_function_stream(events, _DELAY), d)


def stream_cpu_overview(spark, sf_dir):
    d = scratch_dir(spark)
    rows = views.report_view(views.read(spark, sf_dir, "orders"))
    reports = _closed(views.report_view(_stream(spark, sf_dir, "orders")), rows, "reported_at", f"{d}/end")
    return _rounded(_drain(s.cpu_overview_stream(reports, _DELAY), d))


def stream_cpu_function(spark, sf_dir):
    d = scratch_dir(spark)
    reports = views.report_view(views.read(spark, sf_dir, "orders"))
    rows = timed_stats(views.stat_view(views.read(spark, sf_dir, "lineitem")), reports)
    stats = timed_stats(views.stat_view(_stream(spark, sf_dir, "lineitem")), reports)
    return _rounded(_drain(s.cpu_function_stream(_closed(stats, rows, "reported_at", f"{d}/end"), _DELAY), d))


def stream_dedup(spark, sf_dir):
    """Every event arrives twice; one copy is kept."""
    d = scratch_dir(spark)
    twice = views.slow_view(_stream(spark, sf_dir, "events").unionByName(_stream(spark, sf_dir, "events")))
    kept = s.dedup_stream(s.with_event_time(twice, "occurred_at"), SLOW_KEY, "60 days")
    return _drain(kept.select(*SLOW_KEY), d)


_tailed: dict = {}


def _tail(spark, sf_dir):
    from checks.registered import NOW, _log_dir

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _tailed:
        d = scratch_dir(spark)
        store = open_store(spark, f"{d}/store")
        tail_into_store(
            spark, _log_dir(spark, sf_dir), store, f"{d}/checkpoint", lambda: NOW, views.TEXT_CONFIG, finalize=True
        ).awaitTermination()
        _tailed[key] = store
    return _tailed[key]


def stream_tail(spark, sf_dir):
    return _tail(spark, sf_dir).read("slow_events").select(*SLOW_KEY)


def stream_tail_stats(spark, sf_dir):
    return _tail(spark, sf_dir).read("cpu_stats").groupBy("source", "reported_at").agg(
        F.count(F.lit(1)).alias("n"), F.sum("time_ms").alias("time_ms")
    )


def stream_queries():
    return {
        "stream_overview": stream_overview,
        "stream_function": stream_function,
        "stream_cpu_overview": stream_cpu_overview,
        "stream_cpu_function": stream_cpu_function,
        "stream_dedup": stream_dedup,
        "stream_tail": stream_tail,
        "stream_tail_stats": stream_tail_stats,
    }


def stream_sql():
    from checks import oracles as o

    text = [o._SLOW, o._REPORTS, o._STATS, o._TEXT_EVENTS, o._TEXT_REPORTS]
    return {
        "stream_overview": o._with(o._SLOW, o._SLOW30) + "SELECT * FROM agg",
        "stream_function": o._with(o._SLOW, o._SLOW3600) + "SELECT * FROM fagg",
        "stream_cpu_overview": o._with(o._REPORTS, o._CPU30) + """
SELECT source, bucket_time, round(avg_cpu_usage, 6) AS avg_cpu_usage, round(avg_players_online, 6) AS avg_players_online,
  sample_count FROM agg""",
        "stream_cpu_function": o._with(o._REPORTS, o._STATS, o._TIMED, o._CPU3600) + """
SELECT source, bucket_time, description_id, round(max_real_usage, 6) AS max_real_usage,
  round(sum_real_usage, 6) AS sum_real_usage, sum_time_ms, sum_calls, sample_count FROM fagg""",
        "stream_dedup": o._with(o._SLOW) + """
SELECT DISTINCT source, severity, occurred_at, execution_ms, description, detail FROM slow""",
        "stream_tail": o._with(*text) + """
SELECT source, severity, occurred_at, execution_ms, description, detail FROM text_slow""",
        "stream_tail_stats": o._with(*text) + """
SELECT source, reported_at, count(*) AS n, CAST(sum(time_ms) AS BIGINT) AS time_ms FROM text_stats GROUP BY 1, 2""",
    }
