import pytest
from pyspark.sql import functions as F

from perfweave.operators.parse_cpu import block_reports, block_stats, cpu_quarantine, identified, parse_blocks
from perfweave.operators.parse_slow import parse_slow, slow_quarantine, slow_rows

HEAD = "[2/3/2026 9:12:4]"


def slow(spark, *lines, tz="UTC"):
    rows = [(i, x if isinstance(x, bytes) else x.encode()) for i, x in enumerate(lines)]
    return parse_slow(spark.createDataFrame(rows, "n INT, line BINARY"), log_tz=tz)


def one(spark, line, tz="UTC"):
    r = slow(spark, line, tz=tz).first()
    return None if r.status != "ok" else (r.occurred_at, r.execution_ms, r.description, r.detail)


@pytest.mark.parametrize("line, want", [
    (f"{HEAD} Execution time: 32 ms - a(b) - x", (1772442724, 32, "a(b)", "x")),
    (f"{HEAD} Execution time: 32 ms - savePlayer - Renata7\r\n", (1772442724, 32, "savePlayer", "Renata7")),
    (f"{HEAD} Execution time: 32 ms - savePlayer - QuiteALongOne", (1772442724, 32, "QuiteALongOne", "QuiteALongOne")),
    (f"{HEAD} Execution time: 5 ms - SELECT 1 - SELECT 1", (1772442724, 5, "SELECT 1", "SELECT 1")),
    (f"{HEAD} Execution time: 5 ms - SELECT a - b - SELECT a - b", (1772442724, 5, "SELECT a - b - SELECT a", "b")),
    (f"{HEAD} Execution time: 7 ms - a ms - b - c", (1772442724, 7, "a ms - b", "c")),
    (f"{HEAD} Execution time: x7 ms - a - b", (1772442724, 0, "a", "b")),
    (f"{HEAD} Execution time:  -7.9 ms - a - b", (1772442724, -7, "a", "b")),
    (f"{HEAD} Execution time: 5 ms -   - ", (1772442724, 5, "", "")),
    (f"{HEAD}?Execution time: 5 ms - a - b", (1772442724, 5, "a", "b")),
    (f"{HEAD} Execution time: 5 ms - only", None),
    (f"{HEAD}  Execution time: 5 ms - a - b", None),
    ("no bracket", None), ("[no end", None), ("", None), ("\r\n", None),
    ("[31/2/2026 1:1:1] Execution time: 5 ms - a - b", None),
    ("[1/2/2026 24:0:0] Execution time: 5 ms - a - b", None),
    ("[1/2/26 1:1:1] Execution time: 5 ms - a - b", None),
    ("[xx/2/2026 1:1:1] Execution time: 5 ms - a - b", None),
])
def test_slow_line(spark, line, want):
    assert one(spark, line) == want


def test_slow_time_zone(spark):
    assert one(spark, f"{HEAD} Execution time: 5 ms - a - b", "Europe/Warsaw")[0] == 1772442724 - 3600


def test_slow_bytes_are_kept(spark):
    row = slow(spark, HEAD.encode() + b" Execution time: 5 ms - n\xb6me - b").select(
        F.hex(F.col("description").cast("binary")).alias("h")
    ).first()
    assert row.h == b"n\xb6me".hex().upper()
    # Lengths compare in bytes: this detail has fewer characters but more bytes.
    assert one(spark, f"{HEAD} Execution time: 5 ms - abcd - ééé")[2] == "ééé"


def test_slow_quarantine(spark):
    parsed = slow(spark, "junk", "", f"{HEAD} Execution time: 5 ms - a - b", "[31/2/2026 1:1:1] Execution time: 5 ms - a - b")
    assert [(r.n, r.reason) for r in slow_quarantine(parsed).orderBy("n").collect()] == [
        (0, "malformed"), (3, "bad timestamp"),
    ]
    assert slow_rows(parsed).count() == 1


HDR = " Time (ms)     Calls     Rel usage %    Real usage % Description\n"
META = "Thread: 1 Cpu usage: 1.5% Idle: 98.25% Other: -0.25% Players online: 7\n"


def block(spark, text, **options):
    data = text if isinstance(text, bytes) else text.encode()
    df = spark.createDataFrame([("f.log", "lua", 0, data)], "file_key STRING, source STRING, offset BIGINT, record BINARY")
    return parse_blocks(df, **options)


def stats(spark, text):
    rows = block_stats(identified(block(spark, text))).orderBy("stat_no").collect()
    return [(r.time_ms, r.calls, r.rel_usage, r.real_usage, r.description) for r in rows]


def row(t, name, rel="1.5", real="2.5"):
    return f"  {t}  3  {rel}%  {real}% {name}\n"


def test_block_basics(spark):
    text = f"{HEAD}\n{META}{HDR}{row(1, 'a')}{row(2, 'b c')}\n"
    r = block(spark, text).first()
    assert (r.status, r.reported_at, r.lines, r.n_stats) == ("ok", 1772442724, 6, 2)
    assert (r.thread_id, r.cpu_usage, r.idle, r.other, r.players_online) == (1, 1.5, 98.25, -0.25, 7)
    assert stats(spark, text) == [(1, 3, 1.5, 2.5, "a"), (2, 3, 1.5, 2.5, "b c")]


@pytest.mark.parametrize("body, want", [
    # blank lines vanish, continuation lines stay, also bracketed and stamp-like ones
    (row(1, "\ta") + "\n\tmore\n\n[x] y\n [1/2/2024 1:1:1]\n" + row(2, "b"), ["a\n\tmore\n[x] y\n [1/2/2024 1:1:1]", "b"]),
    # no name: dropped together with its continuation
    (row(1, "") + "lost\n" + row(2, "b"), ["b"]),
    ("  1  3  1.5%  2.5%\n" + row(2, "b"), ["b"]),
    # negative or exponent percentages are not statistics
    (row(1, "a") + row(2, "b", rel="-1.0") + row(3, "c", real="1e-5"), ["a\n  2  3  -1.0%  2.5% b\n  3  3  1.5%  1e-5% c"]),
    # a row must begin with a blank
    (row(1, "a") + "5 3 1.0% 1.0% x\n", ["a\n5 3 1.0% 1.0% x"]),
    # lines before the first statistic are ignored
    ("noise\n" + row(1, "a"), ["a"]),
    # whitespace-only lines are not empty
    (row(1, "a") + "   \n" + row(2, "b"), ["a", "b"]),
    (row(1, "a") + "   \nx\n", ["a\n   \nx"]),
    # a second column header is just text
    (row(1, "a") + HDR + row(2, "b"), ["a\n Time (ms)     Calls     Rel usage %    Real usage % Description", "b"]),
])
def test_descriptions(spark, body, want):
    assert [s[4] for s in stats(spark, f"{HEAD}\n{HDR}{body}")] == want
    crlf = f"{HEAD}\n{HDR}{body}".replace("\n", "\r\n")
    assert [s[4] for s in stats(spark, crlf)] == want


@pytest.mark.parametrize("text, status", [
    (f"{HEAD}\n{row(1, 'a')}", "empty"),  # no column header
    (f"{HEAD} Time (ms)\n{row(1, 'a')}", "empty"),  # not on the timestamp line
    (f"{HEAD}\n{HDR}", "empty"),
    (f"{HEAD}\n{HDR}{row(1, '')}", "empty"),
    (f"{HEAD}\n{META.strip()} Time (ms)\n{row(1, 'a')}", "empty"),  # a metrics line is no header
    (f"{HEAD}\nanything Time (ms) else\n{row(1, 'a')}", "ok"),
    (f"text first\n{HDR}{row(1, 'a')}", "prelude"),
    (f"[31/2/2026 1:1:1]\n{HDR}{row(1, 'a')}", "bad timestamp"),
])
def test_block_status(spark, text, status):
    parsed = block(spark, text)
    assert parsed.first().status == status
    assert block_reports(parsed).count() == (status == "ok")
    assert cpu_quarantine(parsed).count() == (status == "bad timestamp")
    assert len(stats(spark, text)) == (status == "ok")


def test_header_metrics(spark):
    again = META.replace("1.5%", "9%")
    r = block(spark, f"{HEAD}\n{META}{again}{HDR}{META}{row(1, 'a')}").first()
    assert r.cpu_usage == 9.0  # the last one before the column header
    sci = META.replace("-0.25%", "3.7e-05%")
    assert block(spark, f"{HEAD}\n{sci}{HDR}{row(1, 'a')}").first().thread_id is None
    r = block(spark, f"{HEAD}\n{sci}{HDR}{row(1, 'a')}", sci_notation=True).first()
    assert (r.other, r.players_online) == (3.7e-05, 7)


def test_odd_numbers(spark):
    text = f"{HEAD}\n{HDR}  99999999999999999999 1 1.2.3% ..% a\n"
    assert stats(spark, text) == [(9223372036854775807, 1, 1.2, 0.0, "a")]


def test_statistics_are_split_by_patterns_compiled_once(spark, capsys):
    """``split`` compiles a pattern of more than one character for every row."""
    rows = block_stats(identified(block(spark, f"{HEAD}\n{META}{HDR}{row(1, 'a  b')}")))
    rows.explain("formatted")
    plan = capsys.readouterr().out
    # Only a header that shares its line with other text is split by its own pattern.
    assert plan.count("split(regexp_replace(") >= 3 and "split(_body" not in plan and "split(ltrim(" not in plan
    assert [r.description for r in rows.collect()] == ["a  b"]


def test_bytes_beyond_ascii_in_statistics(spark):
    text = f"{HEAD}\n{META}{HDR}".encode() + b" 1\t2 3.5%  4.5%\x0b \xc4\x80 \x00n\xb6 5%\n" + row(2, "b").encode()
    found = block_stats(identified(block(spark, text))).orderBy("stat_no").select("rel_usage", "real_usage", F.hex("description").alias("d"))
    assert [tuple(r) for r in found.collect()][0] == (3.5, 4.5, b"\xc4\x80 \x00n\xb6 5%".hex().upper())
