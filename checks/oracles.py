"""The registered queries as SQL over the driver's tables."""

from __future__ import annotations

from checks.registered import CPU_SOURCE, SEEK_CUTOFF, SLOW_SOURCE

_SLOW = """
slow AS (
  SELECT event_id, event_type AS source, CASE WHEN value >= 100 THEN 'very_slow' ELSE 'slow' END AS severity,
         epoch_us(ts) // 1000000 AS occurred_at, CAST(floor(value * 10) AS BIGINT) AS execution_ms,
         user_id + 1 AS description_id, 'fn_' || user_id AS description, props AS detail, user_id
  FROM events)"""

_REPORTS = """
reports AS (
  SELECT o_orderkey AS report_id, o_orderpriority AS source,
         epoch_us(o_orderdate) // 1000000 + (o_orderkey * 37) % 86400 AS reported_at,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice % 100 END AS cpu_usage,
         o_custkey % 1000 AS players_online
  FROM orders)"""

_STATS = """
stats AS (
  SELECT l_orderkey AS report_id, l_partkey + 1 AS description_id, CAST(l_quantity AS BIGINT) AS time_ms,
         CAST(l_linenumber AS BIGINT) AS calls, l_discount * 100 AS rel_usage, l_tax * 100 AS real_usage
  FROM lineitem)"""

_TIMED = """
timed AS (SELECT s.*, r.source, r.reported_at, r.players_online FROM stats s JOIN reports r USING (report_id))"""

# The log text's own view of the tables.
_TEXT_EVENTS = """
lines AS (
  SELECT event_id, source, severity, occurred_at, execution_ms, detail, source || '_' || severity || '.log' AS file_key,
         CASE WHEN user_id % 3 = 0 THEN 'task(a - ' || user_id || ', queue)' ELSE 'fn_' || user_id END AS name
  FROM slow),
text_slow AS (
  SELECT event_id, file_key, source, severity, occurred_at, execution_ms,
         CASE WHEN starts_with(detail, name) OR length(detail) > length(name) THEN detail ELSE name END AS description,
         name, detail
  FROM lines)"""

_SHORT = """CASE source WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium'
         WHEN '4-NOT SPECIFIED' THEN 'unspecified' ELSE 'low' END"""

_TEXT_REPORTS = f"""
text_reports AS (
  SELECT report_id, {_SHORT} AS source, 1704067200 + (report_id * 7919) % 2592000 AS reported_at,
         round(cpu_usage, 5) AS cpu_usage,
         CASE WHEN cpu_usage IS NULL THEN NULL ELSE players_online END AS players_online,
         {_SHORT} || '-w' || ((report_id * 7919) % 2592000 // 604800) || '.log' AS file_key
  FROM reports),
text_stats AS (
  SELECT s.report_id, r.source, r.reported_at, r.file_key, s.time_ms, s.calls, round(s.rel_usage, 5) AS rel_usage,
         round(s.real_usage, 5) AS real_usage, r.cpu_usage, r.players_online, (description_id - 1) % 5 = 0 AS is_long,
         p_name || '#' || p_partkey || CASE WHEN (description_id - 1) % 5 = 0 THEN chr(10) || '[local' || chr(10) || chr(9) || 'function run()' ELSE '' END AS description
  FROM stats s JOIN text_reports r USING (report_id) JOIN part ON p_partkey = s.description_id - 1)"""

_DUR = {"hour": 3600, "day": 86400, "7d": 604800, "14d": 1209600, "30d": 2592000, "all": 345600000}
_BUCKET = {"hour": 30, "day": 60, "7d": 404, "14d": 807, "30d": 1800, "all": 230400}


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


def _end(fact: str, ts: str) -> str:
    return f"(SELECT max({ts}) FROM {fact})"


def _in(ts: str, end: str, range_: str) -> str:
    return f"{ts} > {end} - {_DUR[range_]} AND {ts} <= {end}"


_SLOW_END = _end("slow", "occurred_at")
_CPU_END = _end("reports", "reported_at")

_SLOW30 = """
agg AS (
  SELECT source, occurred_at // 30 * 30 AS bucket_time, count(*) AS event_count, min(execution_ms) AS min_execution_ms,
         max(execution_ms) AS max_execution_ms, CAST(sum(execution_ms) AS BIGINT) AS sum_execution_ms
  FROM slow GROUP BY 1, 2)"""
_SLOW3600 = """
fagg AS (
  SELECT source, occurred_at // 3600 * 3600 AS bucket_time, description_id, count(*) AS event_count,
         min(execution_ms) AS min_execution_ms, max(execution_ms) AS max_execution_ms,
         CAST(sum(execution_ms) AS BIGINT) AS sum_execution_ms
  FROM slow GROUP BY 1, 2, 3)"""
_CPU30 = """
agg AS (
  SELECT source, reported_at // 30 * 30 AS bucket_time, avg(cpu_usage) AS avg_cpu_usage,
         avg(players_online) AS avg_players_online, count(*) AS sample_count,
         count(cpu_usage) AS cpu_usage_samples, count(players_online) AS players_online_samples
  FROM reports GROUP BY 1, 2)"""
_USAGE30 = """
agg AS (
  SELECT source, reported_at // 30 * 30 AS bucket_time, avg(report_total) AS avg_report_real_usage,
         count(*) AS report_count
  FROM (SELECT report_id, source, reported_at, sum(real_usage) AS report_total FROM timed GROUP BY 1, 2, 3)
  GROUP BY 1, 2)"""
_CPU3600 = """
fagg AS (
  SELECT source, reported_at // 3600 * 3600 AS bucket_time, description_id, max(real_usage) AS max_real_usage,
         sum(real_usage) AS sum_real_usage, CAST(sum(time_ms) AS BIGINT) AS sum_time_ms,
         CAST(sum(calls) AS BIGINT) AS sum_calls, count(*) AS sample_count
  FROM timed GROUP BY 1, 2, 3)"""


def _slow_points(ctes, table, ts, measures, range_, more="") -> str:
    return _with(_SLOW, *ctes) + f"""
SELECT t, event_count, min_execution_ms, max_execution_ms, round(total / event_count, 6) AS avg_execution_ms FROM (
  SELECT {ts} // {_BUCKET[range_]} * {_BUCKET[range_]} AS t, {measures}
  FROM {table} WHERE source = '{SLOW_SOURCE}' AND {_in(ts, _SLOW_END, range_)} {more} GROUP BY 1)"""


_RAW = """CAST(count(*) AS BIGINT) AS event_count, min(execution_ms) AS min_execution_ms,
  max(execution_ms) AS max_execution_ms, CAST(sum(execution_ms) AS BIGINT) AS total"""
_ROLL = """CAST(sum(event_count) AS BIGINT) AS event_count, min(min_execution_ms) AS min_execution_ms,
  max(max_execution_ms) AS max_execution_ms, CAST(sum(sum_execution_ms) AS BIGINT) AS total"""

_BUSY_SLOW = "AND description_id = (SELECT description_id FROM slow GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
_BUSY_CPU = "description_id = (SELECT description_id FROM stats GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


def _slow_top(rollup: bool, sort: str) -> str:
    column = {"count": "event_count", "max": "max_execution_ms", "avg": "avg_execution_ms", "total": "total_execution_ms"}[sort]
    table, ts, m, ctes = ("fagg", "bucket_time", _ROLL, [_SLOW3600]) if rollup else ("slow", "occurred_at", _RAW, [])
    return _with(_SLOW, *ctes) + f"""
SELECT description_id, 'fn_' || (description_id - 1) AS description, event_count, min_execution_ms, max_execution_ms,
       round(avg_execution_ms, 6) AS avg_execution_ms, total_execution_ms
FROM (SELECT *, total / event_count AS avg_execution_ms, total AS total_execution_ms FROM (
  SELECT description_id, {m} FROM {table}
  WHERE source = '{SLOW_SOURCE}' AND {_in(ts, _SLOW_END, '30d')} GROUP BY 1))
ORDER BY {column} DESC, description_id LIMIT 50"""


def _cpu_top(rollup: bool, sort: str) -> str:
    column = {"max": "max_real_usage", "avg": "avg_real_usage", "total": "total_time_ms"}[sort]
    if rollup:
        body, ctes = f"""SELECT description_id, max(max_real_usage) AS max_real_usage,
    sum(sum_real_usage) / sum(sample_count) AS avg_real_usage, CAST(sum(sum_time_ms) AS BIGINT) AS total_time_ms,
    CAST(sum(sum_calls) AS BIGINT) AS total_calls FROM fagg
    WHERE source = '{CPU_SOURCE}' AND {_in('bucket_time', _CPU_END, 'all')} GROUP BY 1""", [_CPU3600]
    else:
        body, ctes = f"""SELECT description_id, max(real_usage) AS max_real_usage, avg(real_usage) AS avg_real_usage,
    CAST(sum(time_ms) AS BIGINT) AS total_time_ms, CAST(sum(calls) AS BIGINT) AS total_calls FROM timed
    WHERE source = '{CPU_SOURCE}' AND {_in('reported_at', _CPU_END, 'all')} GROUP BY 1""", []
    # Means that differ only in their last bits must not decide the ranking.
    return _with(_REPORTS, _STATS, _TIMED, *ctes) + f"""
SELECT description_id, p_name || '#' || p_partkey AS description, round(max_real_usage, 6) AS max_real_usage,
       round(avg_real_usage, 6) AS avg_real_usage, total_time_ms, total_calls
FROM ({body}) JOIN part ON p_partkey = description_id - 1
ORDER BY {column} DESC, description_id LIMIT 50"""


def _usage_points(rollup: bool) -> str:
    b = _BUCKET["all"]
    if rollup:
        return _with(_REPORTS, _STATS, _TIMED, _USAGE30) + f"""
SELECT bucket_time // {b} * {b} AS t, round(sum(avg_report_real_usage * report_count) / sum(report_count), 6) AS real_usage
FROM agg WHERE source = '{CPU_SOURCE}' AND {_in('bucket_time', _CPU_END, 'all')} GROUP BY 1"""
    return _with(_REPORTS, _STATS, _TIMED) + f"""
SELECT reported_at // {b} * {b} AS t, round(avg(report_total), 6) AS real_usage FROM (
  SELECT report_id, reported_at, sum(real_usage) AS report_total FROM timed
  WHERE source = '{CPU_SOURCE}' AND {_in('reported_at', _CPU_END, 'all')} GROUP BY 1, 2) GROUP BY 1"""


def _header_points(rollup: bool, range_: str) -> str:
    b = _BUCKET[range_]
    if rollup:
        return _with(_REPORTS, _CPU30) + f"""
SELECT bucket_time // {b} * {b} AS t, round(sum(avg_cpu_usage * sample_count) / sum(sample_count), 6) AS cpu_usage,
       round(sum(avg_players_online * sample_count) / sum(sample_count), 6) AS players_online
FROM agg WHERE source = '1-URGENT' AND {_in('bucket_time', _CPU_END, range_)} GROUP BY 1"""
    return _with(_REPORTS) + f"""
SELECT reported_at // {b} * {b} AS t, round(avg(cpu_usage), 6) AS cpu_usage, round(avg(players_online), 6) AS players_online
FROM reports WHERE source = '1-URGENT' AND {_in('reported_at', _CPU_END, range_)} GROUP BY 1"""


_CPU_SERIES = f"""
SELECT reported_at // {_BUCKET['all']} * {_BUCKET['all']} AS t, round(avg(real_usage), 6) AS real_usage,
       round(avg(time_ms), 6) AS time_ms, round(avg(calls), 6) AS calls, round(avg(players_online), 6) AS players_online
FROM timed WHERE source = '{CPU_SOURCE}' AND {_BUSY_CPU} AND {_in('reported_at', _CPU_END, 'all')} GROUP BY 1"""


def _summary(table: str, fagg: str, ts: str, m: str, lo: int, hi: int, prefix: str) -> str:
    end = _SLOW_END
    span = f"source = '{SLOW_SOURCE}' AND {ts} > {end} - {lo} AND {ts} <= {end} - {hi}"
    return f"""
{prefix}w AS (SELECT {m} FROM {table} WHERE {span}),
{prefix}u AS (SELECT count(DISTINCT description_id) AS unique_functions FROM {fagg} WHERE {span})"""


def _side_by_side(points: str, one_row: str) -> str:
    return f"SELECT * FROM ({points}) points, ({one_row}) one_row"


def _summary_sql(rollup: bool, duration: int, compare: bool) -> str:
    table, fagg, ts, m = ("agg", "fagg", "bucket_time", _ROLL) if rollup else ("slow", "slow", "occurred_at", _RAW)
    ctes = [_SLOW, *([_SLOW30, _SLOW3600] if rollup else []), _summary(table, fagg, ts, m, duration, 0, "c")]

    def side(p: str, name: str) -> str:
        return f"""coalesce({p}w.event_count, 0) AS {name}event_count, {p}w.max_execution_ms AS {name}max_execution_ms,
  round({p}w.total / nullif({p}w.event_count, 0), 6) AS {name}avg_execution_ms, {p}u.unique_functions AS {name}unique_functions"""

    if not compare:
        return _with(*ctes) + f"SELECT {side('c', '')} FROM cw, cu"
    ctes.append(_summary(table, fagg, ts, m, 2 * duration, duration, "p"))

    def pct(now: str, before: str) -> str:
        return f"round(CASE WHEN {before} <> 0 THEN ({now} - {before}) / CAST({before} AS DOUBLE) * 100.0 END, 6)"

    mean = "{0}w.total / nullif({0}w.event_count, 0)"
    return _with(*ctes) + f"""
SELECT {side('c', 'current_')}, {side('p', 'previous_')},
  {pct('coalesce(cw.event_count, 0)', 'coalesce(pw.event_count, 0)')} AS event_count_pct,
  {pct('cw.max_execution_ms', 'pw.max_execution_ms')} AS max_execution_ms_pct,
  {pct(mean.format('c'), mean.format('p'))} AS avg_execution_ms_pct
FROM cw, cu, pw, pu"""


_STAMP = "strftime(make_timestamp({0} * 1000000), '[%-d/%-m/%Y %-H:%-M:%-S]')"

# Fixed values of the log text.
_COLUMNS = " Time (ms)     Calls     Rel usage %    Real usage % Description\n"
_MORE = "\n\n[local\n\tfunction run()"

_FILES = """
files AS (
  SELECT source || '_slow_' || day || '.log' AS file_key, CASE WHEN day % 11 = 0 THEN 0 ELSE size END AS file_size,
         day % 2 = 0 AS is_rolling, 'h' || day AS first_line, day, max_at
  FROM (SELECT source, occurred_at // 86400 AS day, CAST(sum(execution_ms) AS BIGINT) AS size, max(occurred_at) AS max_at
        FROM slow GROUP BY 1, 2)),
state AS (
  SELECT file_key, file_size, CASE day % 6 WHEN 1 THEN file_size WHEN 2 THEN file_size // 2 WHEN 3 THEN file_size + 5 ELSE 0 END AS byte_offset,
         max_at, CASE WHEN day % 6 = 5 THEN 'other' ELSE first_line END AS first_line
  FROM files WHERE day % 6 <> 0)"""

_ALL_FILES = """
all_files AS (
  SELECT DISTINCT file_key, source, severity AS type, severity, true AS is_rolling FROM text_slow
  UNION ALL
  SELECT DISTINCT file_key, source, 'cpu', NULL, false FROM text_reports)"""


def all_sql() -> dict[str, str]:
    from checks.lives import life_sql
    from checks.streams import stream_sql

    text = [_SLOW, _REPORTS, _STATS, _TEXT_EVENTS, _TEXT_REPORTS]
    slow_rows = "SELECT source, severity, occurred_at, execution_ms, description, detail FROM text_slow"
    sql = {
        "slow_overview_raw": _slow_points([], "slow", "occurred_at", _RAW, "30d"),
        "slow_overview_rollup": _slow_points([_SLOW30], "agg", "bucket_time", _ROLL, "30d"),
        "slow_overview_rollup_14d": _slow_points([_SLOW30], "agg", "bucket_time", _ROLL, "14d"),
        "slow_series_raw": _slow_points([], "slow", "occurred_at", _RAW, "30d", _BUSY_SLOW),
        "slow_series_rollup": _slow_points([_SLOW3600], "fagg", "bucket_time", _ROLL, "30d", _BUSY_SLOW),
        "auto_routing": _slow_points([_SLOW30], "agg", "bucket_time", _ROLL, "7d"),
        "auto_routing_raw": _slow_points([], "slow", "occurred_at", _RAW, "7d"),
        "slow_window_summary": _summary_sql(False, _DUR["30d"], False),
        "slow_window_summary_rollup": _summary_sql(True, _DUR["30d"], False),
        "slow_comparison": _summary_sql(False, _DUR["14d"], True),
        "slow_comparison_rollup": _summary_sql(True, _DUR["14d"], True),
        "slow_overview_comparison": _side_by_side(
            _slow_points([], "slow", "occurred_at", _RAW, "14d"), _summary_sql(False, _DUR["14d"], True)),
        "slow_overview_comparison_rollup": _side_by_side(
            _slow_points([_SLOW30], "agg", "bucket_time", _ROLL, "14d"), _summary_sql(True, _DUR["14d"], True)),
        "dispatcher_overview_raw": _header_points(False, "all"),
        "dispatcher_overview_rollup": _header_points(True, "all"),
        "dispatcher_overview_rollup_7d": _header_points(True, "7d"),
        "source_usage_raw": _usage_points(False),
        "source_usage_rollup": _usage_points(True),
        "cpu_series": _with(_REPORTS, _STATS, _TIMED) + _CPU_SERIES,
        "aligned_series": _with(_SLOW) + f"""
SELECT g.t, s.event_count, s.min_execution_ms, s.max_execution_ms, round(s.total / s.event_count, 6) AS avg_execution_ms
FROM (SELECT DISTINCT occurred_at // 1800 * 1800 AS t FROM slow WHERE source = '{SLOW_SOURCE}' AND {_in('occurred_at', _SLOW_END, '30d')}) g
LEFT JOIN (SELECT occurred_at // 1800 * 1800 AS t, {_RAW} FROM slow
  WHERE source = '{SLOW_SOURCE}' AND {_in('occurred_at', _SLOW_END, '30d')} {_BUSY_SLOW} GROUP BY 1) s USING (t)""",
        "cpu_aligned_series": _with(_REPORTS, _STATS, _TIMED, f"series AS ({_CPU_SERIES})") + f"""
SELECT g.t, s.real_usage, s.time_ms, s.calls, s.players_online
FROM (SELECT DISTINCT reported_at // {_BUCKET['all']} * {_BUCKET['all']} AS t FROM timed
      WHERE source = '{CPU_SOURCE}' AND {_in('reported_at', _CPU_END, 'all')}) g LEFT JOIN series s USING (t)""",
        "sparse_min": _with(_SLOW) + f"""
SELECT t, event_count, CASE WHEN event_count >= 3 THEN min_execution_ms END AS min_execution_ms,
       max(event_count) OVER () >= 3 AS show_min
FROM (SELECT occurred_at // 1800 * 1800 AS t, {_RAW} FROM slow
      WHERE source = '{SLOW_SOURCE}' AND {_in('occurred_at', _SLOW_END, '30d')} GROUP BY 1)""",
        "cpu_meta": _with(_REPORTS) + """
SELECT '1-URGENT,2-HIGH,3-MEDIUM,4-NOT SPECIFIED,5-LOW' AS sources, min(reported_at) AS earliest_reported_at,
  max(reported_at) AS latest_reported_at, max(reported_at) AS default_end, (SELECT count(*) FROM part) AS descriptions_rows,
  count(*) AS cpu_reports_rows, (SELECT count(*) FROM lineitem) AS cpu_stats_rows FROM reports""",
        "slow_meta": _with(_SLOW, _SLOW30, _SLOW3600) + """
SELECT 'click,error,purchase,signup,view' AS sources, min(occurred_at) AS earliest_occurred_at,
  max(occurred_at) AS latest_occurred_at, max(occurred_at) AS default_end, count(*) AS slow_events_rows,
  count(DISTINCT description_id) AS descriptions_rows, (SELECT count(*) FROM agg) AS slow_overview_agg_rows,
  (SELECT count(*) FROM fagg) AS slow_function_bucket_agg_rows FROM slow""",
        "time_bounds": _with(_SLOW, _REPORTS) + """
SELECT 'slow_events' AS fact, min(occurred_at) AS earliest, max(occurred_at) AS latest FROM slow
UNION ALL SELECT 'cpu_reports', min(reported_at), max(reported_at) FROM reports""",
        "row_counts": """
SELECT 'descriptions' AS table_name, count(*) AS row_count FROM part UNION ALL SELECT 'cpu_reports', count(*) FROM orders
UNION ALL SELECT 'cpu_stats', count(*) FROM lineitem UNION ALL SELECT 'slow_events', count(*) FROM events""",
        "high_water": _with(_SLOW, _REPORTS) + """
SELECT source, severity, max(occurred_at) AS max_ts FROM slow GROUP BY 1, 2
UNION ALL SELECT source, 'cpu', max(reported_at) FROM reports GROUP BY 1""",
        "rollup_cpu_overview": _with(_REPORTS, _CPU30) + """
SELECT source, bucket_time, round(avg_cpu_usage, 6) AS avg_cpu_usage, round(avg_players_online, 6) AS avg_players_online,
  sample_count, cpu_usage_samples, players_online_samples FROM agg""",
        "rollup_source_usage": _with(_REPORTS, _STATS, _TIMED, _USAGE30) + """
SELECT source, bucket_time, round(avg_report_real_usage, 6) AS avg_report_real_usage, report_count FROM agg""",
        "rollup_cpu_function": _with(_REPORTS, _STATS, _TIMED, _CPU3600) + """
SELECT source, bucket_time, description_id, round(max_real_usage, 6) AS max_real_usage,
  round(sum_real_usage, 6) AS sum_real_usage, sum_time_ms, sum_calls, sample_count FROM fagg""",
        "rollup_slow_overview": _with(_SLOW, _SLOW30) + "SELECT * FROM agg",
        "rollup_slow_function": _with(_SLOW, _SLOW3600) + "SELECT * FROM fagg",
        "parse_slow": _with(*text) + slow_rows,
        "parse_slow_ranges": _with(*text) + slow_rows,
        "rejected_lines": _with(*text) + """
SELECT file_key, 'malformed' AS reason, 'server restarted' AS line, count(*) AS n
FROM text_slow WHERE event_id % 7 = 1 GROUP BY 1""",
        "parse_reports": _with(*text) + """
SELECT source, reported_at, CASE WHEN cpu_usage IS NOT NULL THEN CAST(1 AS BIGINT) END AS thread_id, cpu_usage,
  round(100 - cpu_usage, 5) AS idle, CASE WHEN cpu_usage IS NOT NULL THEN CAST(-0.5 AS DOUBLE) END AS other, players_online
FROM text_reports r WHERE EXISTS (SELECT 1 FROM stats s WHERE s.report_id = r.report_id)""",
        "parse_stats": _with(*text) + """
SELECT source, reported_at, time_ms, calls, rel_usage, real_usage, description FROM text_stats""",
        "sanitize_text": """
SELECT event_id, 'fn_' || chr(65533) || user_id AS description, 4 + length(CAST(user_id AS VARCHAR)) AS stored_bytes FROM events""",
        "classify_files": """
SELECT event_id, event_type || tail AS file_key, event_type AS source, type, CASE WHEN type <> 'cpu' THEN type END AS severity,
       tail IN ('.log', '_slow.log', '_very_slow.log') AS is_rolling
FROM (SELECT *, CASE event_id % 9 WHEN 0 THEN '.log' WHEN 1 THEN '_slow.log' WHEN 2 THEN '_very_slow.log' WHEN 3 THEN '_2024-01-01.log'
        WHEN 4 THEN '-old.log' WHEN 5 THEN 'x.log' WHEN 6 THEN '_very_slow_3.log' WHEN 7 THEN '_slow-7.log' ELSE '.txt' END AS tail,
      CASE WHEN event_id % 9 IN (2, 6) THEN 'very_slow' WHEN event_id % 9 IN (1, 7) THEN 'slow' WHEN event_id % 9 IN (0, 3, 4) THEN 'cpu' END AS type
      FROM events) WHERE type IS NOT NULL""",
        "catalog": _with(*text, _ALL_FILES) + "SELECT * FROM all_files",
        "fingerprint": _with(*text) + f"""
SELECT file_key, sha256(arg_min(line, pos)) AS first_line FROM (
  SELECT file_key, (occurred_at, event_id) AS pos,
         {_STAMP.format('occurred_at')} || ' Execution time: ' || execution_ms || ' ms - ' || name || ' - ' || detail AS line
  FROM text_slow UNION ALL
  SELECT file_key, (reported_at, report_id), {_STAMP.format('reported_at')} FROM text_reports) GROUP BY 1""",
        "log_bytes": _with(*text) + f"""
SELECT total AS total_bytes, total AS pending_before, CAST(0 AS BIGINT) AS pending_after FROM (SELECT CAST(sum(n) AS BIGINT) AS total FROM (
  SELECT length({_STAMP.format('occurred_at')} || ' Execution time: ' || execution_ms || ' ms - ' || name || ' - ' || detail)
         + CASE WHEN event_id % 5 = 0 THEN 2 ELSE 1 END
         + CASE event_id % 7 WHEN 0 THEN 1 WHEN 1 THEN {len("server restarted") + 1} ELSE 0 END AS n FROM text_slow
  UNION ALL
  SELECT length({_STAMP.format('t.reported_at')}) + 2 + {len(_COLUMNS)} + CASE WHEN r.cpu_usage IS NULL THEN 0 ELSE length(
           'Thread: 1 Cpu usage: ' || format('{{:.5f}}', r.cpu_usage) || '% Idle: ' || format('{{:.5f}}', 100 - r.cpu_usage)
           || '% Other: -0.5% Players online: ' || r.players_online) + 1 END
  FROM text_reports t JOIN reports r USING (report_id)
  UNION ALL
  SELECT 54 + length(p_name || '#' || p_partkey) + CASE WHEN p_partkey % 5 = 0 THEN {len(_MORE)} ELSE 0 END
  FROM lineitem JOIN part ON p_partkey = l_partkey))""",
        "seek_offsets": _with(*text) + f"""
SELECT file_key, min(reported_at) AS reported_at FROM text_reports WHERE reported_at >= {SEEK_CUTOFF} GROUP BY 1""",
        "resume_plan": _with(_SLOW, _FILES) + """
SELECT file_key, action, CASE action WHEN 'append' THEN byte_offset WHEN 'up_to_date' THEN file_size ELSE 0 END AS start_offset,
       action = 'up_to_date' AND byte_offset > file_size AS shrunk
FROM (SELECT f.file_key, f.file_size, s.byte_offset,
        CASE WHEN f.file_size = 0 THEN 'skip_empty' WHEN s.first_line <> f.first_line THEN 'replaced'
             WHEN s.byte_offset >= f.file_size THEN 'up_to_date' WHEN s.byte_offset > 0 THEN 'append'
             WHEN s.file_key IS NULL AND is_rolling THEN 'seek' ELSE 'full' END AS action
      FROM files f LEFT JOIN state s USING (file_key))""",
        "state_upsert": _with(_SLOW, _FILES) + """
SELECT file_key, CASE WHEN day % 3 = 0 THEN f.file_size ELSE s.byte_offset END AS byte_offset, f.file_size,
       strftime(make_timestamp(f.max_at * 1000000), '%Y-%m-%d %H:%M:%S') AS max_timestamp
FROM files f LEFT JOIN state s USING (file_key) WHERE s.file_key IS NOT NULL OR day % 3 = 0""",
        "window_filters": _with(_SLOW) + f"""
SELECT source, severity, 'first' AS run, count(*) AS n FROM slow WHERE occurred_at >= {_SLOW_END} - 20 * 86400 GROUP BY 1, 2
UNION ALL SELECT source, severity, 'incremental', count(*) FROM slow WHERE occurred_at >= {_SLOW_END} - 7 * 86400 GROUP BY 1, 2""",
        "dedup_slow": _with(_SLOW).rstrip() + """,
cut AS (SELECT (min(occurred_at) + max(occurred_at)) // 2 AS middle FROM slow),
stored AS (SELECT slow.* FROM slow, cut WHERE event_id % 4 <> 0 AND occurred_at <= middle),
mark AS (SELECT source, severity, max(occurred_at) AS mark FROM stored GROUP BY 1, 2),
late AS (SELECT slow.* FROM slow, cut WHERE occurred_at > middle - 3 * 86400),
twice AS (SELECT l.*, mark FROM (SELECT * FROM late UNION ALL SELECT * FROM late WHERE execution_ms % 3 = 0) l LEFT JOIN mark USING (source, severity))
SELECT source, severity, occurred_at, execution_ms, description, detail FROM twice WHERE occurred_at > mark
UNION ALL
SELECT DISTINCT source, severity, occurred_at, execution_ms, description, detail FROM twice t
WHERE (mark IS NULL OR occurred_at <= mark) AND NOT EXISTS (
  SELECT 1 FROM stored s WHERE (s.source, s.severity, s.occurred_at, s.execution_ms, s.description, s.detail)
    = (t.source, t.severity, t.occurred_at, t.execution_ms, t.description, t.detail))""",
        "dedup_cpu": _with(_REPORTS, _STATS, _TIMED).rstrip() + """,
cut AS (SELECT (min(reported_at) + max(reported_at)) // 2 AS middle FROM reports),
stored AS (SELECT timed.* FROM timed, cut WHERE report_id % 4 <> 0 AND reported_at <= middle),
mark AS (SELECT source, max(reported_at) AS mark FROM stored GROUP BY 1),
late AS (SELECT timed.* FROM timed, cut WHERE reported_at > middle - 100 * 86400),
twice AS (SELECT l.*, mark FROM (SELECT * FROM late UNION ALL SELECT * FROM late WHERE time_ms % 3 = 0) l LEFT JOIN mark USING (source))
SELECT source, reported_at, description_id, time_ms, calls, round(rel_usage, 6) AS rel_usage, round(real_usage, 6) AS real_usage FROM (
SELECT source, reported_at, description_id, time_ms, calls, rel_usage, real_usage FROM twice WHERE reported_at > mark
UNION ALL
SELECT DISTINCT source, reported_at, description_id, time_ms, calls, rel_usage, real_usage FROM twice t
WHERE (mark IS NULL OR reported_at <= mark) AND NOT EXISTS (
  SELECT 1 FROM stored s WHERE (s.source, s.reported_at, s.description_id, s.time_ms, s.calls, s.rel_usage, s.real_usage)
    = (t.source, t.reported_at, t.description_id, t.time_ms, t.calls, t.rel_usage, t.real_usage)))""",
        "dim_upsert": _with(_SLOW) + """
SELECT DISTINCT source, description FROM slow
EXCEPT SELECT source, description FROM slow WHERE description_id % 2 = 0""",
        "dim_lookup": _with(_SLOW) + """
SELECT source, CASE WHEN description_id % 2 = 0 THEN description_id END AS description_id, count(*) AS n FROM slow GROUP BY 1, 2""",
        "slow_envelope": _with(_SLOW) + f"""
SELECT 'click' AS source, '30d' AS range, {_SLOW_END} - {_DUR['30d']} AS start, {_SLOW_END} AS "end", {_BUCKET['30d']} AS bucket_seconds,
  CAST(NULL AS BIGINT) AS description_id, CAST(NULL AS VARCHAR) AS description
UNION ALL
SELECT min(source), '7d', {_SLOW_END} - {_DUR['7d']}, {_SLOW_END}, {_BUCKET['7d']}, description_id, min(description) FROM slow
WHERE description_id = (SELECT description_id FROM slow GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) GROUP BY description_id""",
        "cpu_envelope": _with(_REPORTS) + f"""
SELECT '2-HIGH' AS source, 'all' AS range, {_CPU_END} - {_DUR['all']} AS start, {_CPU_END} AS "end", {_BUCKET['all']} AS bucket_seconds""",
        "dim_collisions": "SELECT CAST(0 AS BIGINT) AS collisions",
        "import_slow_events": _with(*text) + slow_rows,
        "import_cpu_stats": _with(*text) + """
SELECT source, reported_at, description, time_ms, calls, rel_usage, real_usage, cpu_usage, players_online FROM text_stats""",
        "import_counts": _with(*text) + """
SELECT 'descriptions' AS table_name, count(*) AS row_count FROM (
  SELECT DISTINCT source, description FROM text_slow UNION SELECT DISTINCT source, description FROM text_stats)
UNION ALL SELECT 'cpu_reports', count(DISTINCT report_id) FROM text_stats
UNION ALL SELECT 'cpu_stats', count(*) FROM text_stats UNION ALL SELECT 'slow_events', count(*) FROM text_slow""",
        "import_top_rollup": _with(*text) + f"""
SELECT total_time_ms FROM (
  SELECT description, CAST(sum(time_ms) AS BIGINT) AS total_time_ms FROM text_stats, (SELECT max(reported_at) AS latest FROM text_stats)
  WHERE source = 'high' AND reported_at // 3600 * 3600 > latest - {_DUR['14d']} AND reported_at // 3600 * 3600 <= latest GROUP BY 1)
ORDER BY 1 DESC LIMIT 50""",
        "ingest_audit": _with(*text) + """
SELECT file_key, 'full' AS action, CAST(sum(1 + CAST(event_id % 7 IN (0, 1) AS INT)) AS BIGINT) AS lines_read,
       count(*) AS rows_inserted, CAST(0 AS BIGINT) AS rows_skipped, max(occurred_at) AS max_ts
FROM text_slow GROUP BY 1
UNION ALL
SELECT file_key, 'full', CAST(sum(3 + CAST(cpu_usage IS NOT NULL AS INT) + coalesce(n, 0) + coalesce(extra, 0)) AS BIGINT),
       CAST(sum(coalesce(n, 0)) AS BIGINT), CAST(0 AS BIGINT), max(CASE WHEN n > 0 THEN reported_at END)
FROM text_reports LEFT JOIN (
  SELECT report_id, count(*) AS n, 3 * count_if(is_long) AS extra FROM text_stats GROUP BY 1) USING (report_id) GROUP BY 1""",
        "import_status": _with(*text) + """
SELECT file_key, strftime(make_timestamp(max(stamp) * 1000000), '%Y-%m-%d %H:%M:%S') AS max_timestamp, true AS read_whole FROM (
  SELECT file_key, occurred_at AS stamp FROM text_slow UNION ALL SELECT file_key, reported_at FROM text_stats) GROUP BY 1""",
    }
    for sort in ("count", "max", "avg", "total"):
        sql[f"slow_top_{sort}"] = _slow_top(False, sort)
        sql[f"slow_top_rollup_{sort}"] = _slow_top(True, sort)
    for sort in ("max", "avg", "total"):
        sql[f"cpu_top_{sort}"] = _cpu_top(False, sort)
        sql[f"cpu_top_rollup_{sort}"] = _cpu_top(True, sort)
    return {**sql, **stream_sql(), **life_sql()}
