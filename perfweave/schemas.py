"""Explicit schemas of every stored table (never inferred)."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"BIGINT": T.LongType(), "DOUBLE": T.DoubleType(), "STRING": T.StringType(), "DATE": T.DateType()}


def _schema(spec: str) -> T.StructType:
    """Schema of "name TYPE, ..."; unlike ``StructType.fromDDL`` it needs no running session."""
    pairs = (column.split() for column in spec.split(","))
    return T.StructType([T.StructField(name, _TYPES[type_]) for name, type_ in pairs])


DESCRIPTIONS = _schema("description_id BIGINT, source STRING, description STRING")

CPU_REPORTS = _schema(
    "report_id BIGINT, reported_at BIGINT, thread_id BIGINT, cpu_usage DOUBLE, idle DOUBLE, "
    "other DOUBLE, players_online BIGINT, source STRING, event_date DATE"
)

CPU_STATS = _schema(
    "report_id BIGINT, description_id BIGINT, reported_at BIGINT, players_online BIGINT, "
    "time_ms BIGINT, calls BIGINT, rel_usage DOUBLE, real_usage DOUBLE, "
    "source STRING, event_date DATE"
)

SLOW_EVENTS = _schema(
    "severity STRING, occurred_at BIGINT, execution_ms BIGINT, description_id BIGINT, "
    "description STRING, detail STRING, source STRING, event_date DATE"
)

CPU_OVERVIEW_AGG = _schema(
    "bucket_time BIGINT, avg_cpu_usage DOUBLE, avg_players_online DOUBLE, sample_count BIGINT, "
    "cpu_usage_samples BIGINT, players_online_samples BIGINT, source STRING, event_date DATE"
)

CPU_SOURCE_USAGE_AGG = _schema(
    "bucket_time BIGINT, avg_report_real_usage DOUBLE, report_count BIGINT, "
    "source STRING, event_date DATE"
)

CPU_FUNCTION_AGG = _schema(
    "bucket_time BIGINT, description_id BIGINT, max_real_usage DOUBLE, sum_real_usage DOUBLE, "
    "sum_time_ms BIGINT, sum_calls BIGINT, sample_count BIGINT, source STRING, event_date DATE"
)

SLOW_OVERVIEW_AGG = _schema(
    "bucket_time BIGINT, event_count BIGINT, min_execution_ms BIGINT, max_execution_ms BIGINT, "
    "sum_execution_ms BIGINT, source STRING, event_date DATE"
)

SLOW_FUNCTION_AGG = _schema(
    "bucket_time BIGINT, description_id BIGINT, event_count BIGINT, min_execution_ms BIGINT, "
    "max_execution_ms BIGINT, sum_execution_ms BIGINT, source STRING, event_date DATE"
)

IMPORT_FILES = _schema(
    "file_key STRING, path STRING, file_size BIGINT, file_mtime BIGINT, byte_offset BIGINT, "
    "max_occurred_at BIGINT, first_line STRING, updated_at BIGINT"
)

# As stored: besides, where the record begins that was open at the file's end.
STORED_FILES = T.StructType([*IMPORT_FILES.fields, T.StructField("open_offset", T.LongType())])

HIGH_WATER = _schema("source STRING, severity STRING, max_ts BIGINT")

INGEST_AUDIT = _schema(
    "file_key STRING, source STRING, action STRING, bytes_read BIGINT, lines_read BIGINT, "
    "rows_inserted BIGINT, rows_skipped BIGINT, max_ts BIGINT"
)

QUARANTINE = _schema("file_key STRING, source STRING, offset BIGINT, reason STRING, line STRING")

ROLLUPS = {
    "cpu_overview_agg": CPU_OVERVIEW_AGG,
    "cpu_source_usage_agg": CPU_SOURCE_USAGE_AGG,
    "cpu_function_bucket_agg": CPU_FUNCTION_AGG,
    "slow_overview_agg": SLOW_OVERVIEW_AGG,
    "slow_function_bucket_agg": SLOW_FUNCTION_AGG,
}

# What a run stores of a rollup: sums and counts that add up over runs.
PARTIALS = {
    **ROLLUPS,
    "cpu_overview_agg": _schema(
        "bucket_time BIGINT, sum_cpu_usage DOUBLE, sum_players_online BIGINT, sample_count BIGINT, "
        "cpu_usage_samples BIGINT, players_online_samples BIGINT, source STRING, event_date DATE"
    ),
    "cpu_source_usage_agg": _schema(
        "bucket_time BIGINT, sum_real_usage DOUBLE, report_count BIGINT, source STRING, event_date DATE"
    ),
}


def opened(schema: T.StructType) -> T.StructType:
    """Schema of rows read from a record that is still open."""
    return T.StructType([T.StructField("file_key", T.StringType()), *schema.fields])
