"""Byte-range reading of log files, for what the text reader cannot express.

Three things need byte positions: resuming a grown file where the last import stopped,
keeping a multi-line report together across split boundaries, and tailing a live file.
A file is cut into ranges; every range is one row of a DataFrame, Spark spreads the rows
over tasks, and a task reads only its bytes. A record belongs to the range its first byte
lies in, so any cut gives the same records, and nothing is shuffled but the range list.

Python finds record boundaries only, over whole buffers; parsing is left to Catalyst.
"""

from __future__ import annotations

import hashlib
import re
import sys
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Executors need no copy of this package: its functions travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

READ_BYTES = 8 * 1024 * 1024
PROBE_BYTES = 64 * 1024

# Fixed value: a line that begins a report (or a slow event).
_STAMP = rb"\n\[(\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2})\]"

# Fixed value: a statistics line with a name.
_STAT = rb"\n[ \t\x0b\f\r]+\d+[ \t\x0b\f\r]+\d+[ \t\x0b\f\r]+[\d.]+%[ \t\x0b\f\r]+[\d.]+%[ \t\x0b\f\r]+[^ \t\x0b\f\r\n]"
_COLUMN_HEADER = b"Time (ms)"

# A longer record comes in parts, so a task never holds much more.
MOST_RECORD_BYTES = 64 * 1024 * 1024
# What must be known of the text behind a cut: a stamp or the figures of a statistic that lie across it.
LOOK_AHEAD_BYTES = 4096

# Flat columns: a struct would have Catalyst move its fields below the parse, and evaluate that twice.
CONTINUES = ("report_offset", "head_bytes", "head_lines")
CONTINUES_SCHEMA = ", ".join(f"{c} BIGINT" for c in CONTINUES)
RECORD_SCHEMA = (
    "file_key STRING, source STRING, severity STRING, range_start BIGINT, "
    f"offset BIGINT, record BINARY, is_open BOOLEAN, {CONTINUES_SCHEMA}"
)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The store a path lies on, and the path there."""
    # Spark lists paths as they are named, with blanks and percent signs; in a URI these are escaped.
    if path.startswith("/"):
        return pafs.LocalFileSystem(), path
    scheme, _, rest = path.partition(":")
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]$", "s3", scheme) + ":" + quote(rest, safe="/@:[]"))


def open_log(path: str):
    """Random-access file on any store Arrow knows (local or mounted, HDFS, S3, GCS)."""
    fs, inner = file_system(path)
    return fs.open_input_file(inner)


def record_starts(buf: bytes, blocks: bool) -> np.ndarray:
    """Positions in ``buf`` (from 1 on) where a record begins; ``buf[0]`` precedes them."""
    if blocks:
        return np.fromiter((m.start() + 1 for m in re.finditer(_STAMP, buf)), dtype=np.int64)
    return np.flatnonzero(np.frombuffer(buf, dtype=np.uint8) == 10).astype(np.int64) + 1


def _slices(buf: bytes, starts: np.ndarray, stop: int) -> pa.Array:
    """``buf[starts[i]:starts[i+1]]`` for all i as one Arrow column, without copying."""
    if stop >= 2**31:
        raise ValueError("a single log record exceeds 2 GiB")
    bounds = np.append(starts, stop).astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(starts), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(buf)]
    )


class _Long:
    """A record longer than ``most`` bytes, cut at places that its own bytes alone decide.

    A report is cut before statistics, and every part but the first is given the report's head (its lines up to
    the first statistic), so that it parses like a report; ``continues`` tells it from one. Text without a stamp,
    or without statistics in its first ``most`` bytes, is cut at a line feed, or else anywhere. A single
    statistic or slow event is never cut.
    """

    def __init__(self, offset: int, text: bytes, blocks: bool, most: int):
        self.offset, self.blocks, self.most = offset, blocks, most
        self.stamped = re.match(_STAMP, b"\n" + text[:64]) is not None
        self.head: bytes | None = None
        if self.stamped and blocks:
            header = text.find(_COLUMN_HEADER, 0, most)
            stat = re.compile(_STAT).search(text, header, most + LOOK_AHEAD_BYTES) if header >= 0 else None
            if stat and stat.start() < most:
                self.head = text[: stat.start()]
            else:
                self.stamped = False
        self.begun = False

    def cut(self, text: bytes, whole: bool) -> int | None:
        """Length of the next part, which ``text`` begins with; None if more must be read to tell."""
        if whole and len(text) <= self.most:
            return len(text)
        if not whole and len(text) < self.most + LOOK_AHEAD_BYTES:
            return None
        if not self.stamped:
            return (text.rfind(b"\n", 0, self.most) + 1 if self.blocks else 0) or self.most
        at = None
        if self.head is not None:
            # The first statistic of the text is never cut off.
            for m in re.compile(_STAT).finditer(text, 0 if self.begun else len(self.head) + 1):
                if at is None or m.start() < self.most:
                    at = m.start() + 1
                if m.start() >= self.most:
                    break
        return at if at is not None else len(text) if whole else None

    def part(self, at: int, text: bytes) -> tuple[np.ndarray, pa.Array, tuple | None]:
        """The part at file offset ``at``, as ``read_range`` gives it."""
        continues = None
        if self.begun and self.head is not None:
            head = self.head + b"\n"
            text, continues = head + text, (self.offset, len(head), head.count(b"\n"))
        self.begun = True
        return np.array([at], dtype=np.int64), _slices(text, np.zeros(1, dtype=np.int64), len(text)), continues

    def parts(self, at: int, text: bytes, whole: bool) -> Iterator[tuple[int, tuple]]:
        """Parts that ``text`` from file offset ``at`` on holds, with where each ends in it."""
        done = 0
        while done < len(text) and (n := self.cut(text[done:], whole)) is not None:
            done += n
            yield done, self.part(at + done - n, text[done - n : done])


def _finished(
    buf: bytes, starts: np.ndarray, stop: int, origin: int, blocks: bool, most: int, long: _Long | None
) -> Iterator[tuple[np.ndarray, pa.Array, tuple | None]]:
    """The records of ``buf`` from ``starts[0]`` to ``stop``; ``long`` is the one that the first goes on with."""
    bounds = np.append(starts, stop)
    cut = np.diff(bounds) > most
    cut[0] |= long is not None
    done = 0
    for i in [*np.flatnonzero(cut).tolist(), len(starts)]:
        if done < i:
            yield starts[done:i] + origin, _slices(buf, starts[done:i], int(bounds[i])), None
        if i < len(starts):
            text, at = buf[int(bounds[i]) : int(bounds[i + 1])], int(starts[i]) + origin
            record = long if long is not None and i == 0 else _Long(at, text, blocks, most)
            yield from (part for _, part in record.parts(at, text, True))
        done = i + 1


def read_range(
    f,
    start: int,
    end: int,
    base: int,
    blocks: bool,
    hold_open: bool = False,
    limit: int | None = None,
    read_bytes: int = READ_BYTES,
    most: int = MOST_RECORD_BYTES,
) -> Iterator[tuple[np.ndarray, pa.Array, tuple | None]]:
    """(file offsets, record bytes, continues) of the records whose first byte lies in [start, end).

    ``base`` is where reading of the file begins and always starts a record. With ``hold_open``
    the file's last, possibly unfinished record is left for a later read. ``limit`` is taken for
    the end of the file when it grows meanwhile. A record longer than ``most`` bytes comes in parts (see
    ``_Long``); ``continues`` is (offset of the report, bytes and lines put before the part) for a
    report's further parts and None for all else.
    """
    if hold_open:
        if limit is None:
            f.seek(0, 2)
            limit = f.tell()
        limit = open_tail_offset(f, limit, base, blocks)
    long: _Long | None = None
    if start <= base:
        f.seek(base)
        carry, origin, at_base = b"\n", base - 1, True
    else:
        f.seek(start - 1)
        carry, origin, at_base = b"", start - 1, False

    def piece() -> int:
        """What to read next: not far beyond the range, whose rest another task reads."""
        return min(read_bytes, max(end - f.tell(), 0) + PROBE_BYTES)

    step = piece()
    while True:
        data = f.read(step if limit is None else min(step, max(limit - f.tell(), 0)))
        buf = carry + data
        starts = record_starts(buf, blocks)
        if at_base and (starts.size == 0 or starts[0] != 1) and len(buf) > 1:
            starts = np.insert(starts, 0, 1)
        starts = starts[starts < len(buf)]
        offsets = starts + origin
        # A long record begun in the range may go on beyond it.
        inside = max(int(np.searchsorted(offsets, end)), int(long is not None))
        if inside < len(starts):
            if inside:
                yield from _finished(buf, starts[:inside], int(starts[inside]), origin, blocks, most, long)
            return
        if not data:
            if len(starts):
                yield from _finished(buf, starts, len(buf), origin, blocks, most, long)
            return
        if len(starts) == 0 and origin + len(buf) >= end:
            # Past the range without a record of its own. A boundary may straddle the buffer's
            # end, but a record found there would start at or after `end` - keep a stamp's width.
            if origin + len(buf) >= end + 64:
                return
        if len(starts) > 1:
            last = int(starts[-1])
            yield from _finished(buf, starts[:-1], last, origin, blocks, most, long)
            carry, origin, at_base, step, long = buf[last - 1:], int(offsets[-1]) - 1, False, piece(), None
            # The carried record's start stays recognisable: its line feed is kept, except that
            # the record at `base` may not look like one.
        elif len(starts) == 1:
            at_base = at_base and int(starts[0]) == 1
            first, done = int(starts[0]), 0
            if len(buf) - first >= most + LOOK_AHEAD_BYTES:
                text = buf[first:]
                long = long or _Long(int(offsets[0]), text, blocks, most)
                for done, part in long.parts(int(offsets[0]), text, False):
                    yield part
            if done:
                # What is left starts where it starts, whatever it looks like.
                carry, origin, at_base, step = b"\n" + text[done:], int(offsets[0]) + done - 1, True, read_bytes
                continue
            if not at_base:
                carry, origin = buf[first - 1:], int(offsets[0]) - 1
            else:
                carry = buf
            step = min(step * 2, 16 * read_bytes)
        else:
            keep = min(len(buf), 64)
            carry, origin = buf[-keep:], origin + len(buf) - keep


def open_tail_offset(f, size: int, base: int, blocks: bool) -> int:
    """Offset of the still-open end of a file: its last report, or its last partial line.

    Reads backwards from the end only as far as that record reaches, piece by piece.
    """
    span, hi = PROBE_BYTES, size
    while True:
        lo = max(base, hi - span)
        origin = max(lo - 1, 0)
        f.seek(origin)
        # A stamp may lie across the end of the piece.
        buf = f.read(min(hi + 64, size) - origin)
        if lo <= base:
            buf, origin = b"\n" + buf[base - origin:], base - 1
        starts = record_starts(buf, blocks)
        if starts.size:
            return int(starts[-1]) + origin
        if lo <= base:
            return base
        span, hi = min(span * 4, READ_BYTES), lo


def first_line_hash(f) -> str | None:
    """sha256 of the first non-empty line, line end removed; None for a file without one."""
    digest, begun, returns = hashlib.sha256(), False, b""
    while data := f.read(PROBE_BYTES):
        while data:
            line, feed, data = data.partition(b"\n")
            # Carriage returns count only if something follows them.
            line = returns + line
            text = line.rstrip(b"\r")
            if text:
                digest.update(text)
                begun = True
            if feed and begun:
                return digest.hexdigest()
            returns = b"" if feed else line[len(text):]
    return digest.hexdigest() if begun else None


def first_stamp(f, pos: int, limit: int, log_tz: str) -> tuple[int, int] | None:
    """(epoch second, offset) of the first timestamped line starting in [pos, limit)."""
    from datetime import datetime
    from zoneinfo import ZoneInfo

    f.seek(max(pos - 1, 0))
    carry, origin = (b"\n", -1) if pos == 0 else (b"", pos - 1)
    while origin + len(carry) < limit + 64:
        data = f.read(PROBE_BYTES)
        carry += data
        for m in re.finditer(_STAMP, carry):
            at = m.start() + 1 + origin
            if at >= limit:
                return None
            try:
                day, month, year, h, mi, s = map(int, re.split(rb"[/ :]", m[1]))
                stamp = datetime(year, month, day, h, mi, s, tzinfo=ZoneInfo(log_tz))
            except ValueError:
                continue
            return int(stamp.timestamp()), at
        if not data:
            return None
        keep = min(len(carry), 64)
        carry, origin = carry[-keep:], origin + len(carry) - keep
    return None


def seek_offset(f, size: int, cutoff: int, log_tz: str, step: int = PROBE_BYTES) -> int:
    """Offset of the first timestamped line at or after ``cutoff`` in a time-sorted log, or
    ``size`` when there is none. Probes O(log(size / step)) places, then one step of lines."""

    def reaches_cutoff(i: int) -> bool:
        found = first_stamp(f, i * step, size, log_tz)
        return found is None or found[0] >= cutoff

    cells = -(-size // step)
    cell = bisect_left(range(cells), True, key=reaches_cutoff)
    pos = max(cell - 1, 0) * step
    while (found := first_stamp(f, pos, size, log_tz)) is not None:
        if found[0] >= cutoff:
            return found[1]
        pos = found[1] + 1
    return size


def continues_columns(continues: tuple | None, n: int) -> list[pa.Array]:
    """The columns of ``CONTINUES`` of n records read together."""
    return [pa.repeat(pa.scalar(v, pa.int64()), n) for v in continues or (None,) * len(CONTINUES)]


def _plus(df: DataFrame, column: str) -> T.StructType:
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(column).fields])


def with_fingerprints(files: DataFrame) -> DataFrame:
    """Adds first_line, the fingerprint that tells a replaced file from a grown one.

    Every task reads only the head of its files.
    """

    def run(batches):
        for batch in batches:
            out = []
            for path, size in zip(batch["path"].to_pylist(), batch["file_size"].to_pylist()):
                if size == 0:
                    out.append(None)
                    continue
                with open_log(path) as f:
                    out.append(first_line_hash(f))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "first_line"]
            )

    return files.mapInArrow(run, _plus(files, "first_line STRING"))


def with_seek_offsets(files: DataFrame, cutoff: int, log_tz: str) -> DataFrame:
    """Adds seek_offset: where a time-sorted log reaches ``cutoff``."""

    def run(batches):
        for batch in batches:
            out = []
            for path, size in zip(batch["path"].to_pylist(), batch["file_size"].to_pylist()):
                with open_log(path) as f:
                    out.append(seek_offset(f, size, cutoff, log_tz))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "seek_offset"]
            )

    return files.mapInArrow(run, _plus(files, "seek_offset BIGINT"))


def with_open_tail(files: DataFrame) -> DataFrame:
    """Adds open_offset: where the unfinished last record of each file begins, and whole_first: whether
    the first line has been written to its end.

    Reads each file's tail only. Input needs path, type, file_size and start_offset.
    """

    def run(batches):
        for batch in batches:
            out, whole = [], []
            cols = (batch[c].to_pylist() for c in ("path", "type", "file_size", "start_offset"))
            for path, kind, size, base in zip(*cols):
                with open_log(path) as f:
                    out.append(open_tail_offset(f, size, base, kind == "cpu"))
                    whole.append(out[-1] > 0 or open_tail_offset(f, size, 0, False) > 0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out, pa.int64()), pa.array(whole, pa.bool_())],
                names=[*batch.schema.names, "open_offset", "whole_first"],
            )

    return files.mapInArrow(run, _plus(files, "open_offset BIGINT, whole_first BOOLEAN"))


def cut_ranges(plan: DataFrame, range_bytes: int, n_tasks: int) -> DataFrame:
    """Byte ranges of the files in ``plan`` (path, file_size, start_offset), spread evenly.

    Only the list of ranges moves, not log text. The explicit count keeps AQE from folding
    the tiny list into one task.
    """
    spans = plan.filter("file_size > start_offset").withColumn(
        "range_start", F.explode(F.sequence("start_offset", F.col("file_size") - 1, F.lit(range_bytes).cast("bigint")))
    )
    return spans.withColumn(
        "range_end", F.least(F.col("range_start") + range_bytes, F.col("file_size"))
    ).repartition(max(1, n_tasks))


def range_count(plan: DataFrame, range_bytes: int) -> int:
    """How many ranges ``cut_ranges`` makes: one number from the file list."""
    n = F.ceil((F.col("file_size") - F.col("start_offset")) / F.lit(range_bytes))
    row = plan.filter("file_size > start_offset").agg(F.sum(n).alias("n")).first()
    return int(row["n"] or 0)


def read_records(ranges: DataFrame, blocks: bool, hold_open: bool = False) -> DataFrame:
    """Records of the given ranges: whole report blocks, or single lines.

    Columns of ``RECORD_SCHEMA``; ``offset`` is the record's byte position in its file, and ``is_open``
    marks a record from the file's ``open_offset`` on (if the ranges have one), which may still grow. In
    block mode, text before the first timestamp of a file is a record of its own. Further parts of a report
    longer than ``MOST_RECORD_BYTES`` carry its offset and the size of the head put before them (``CONTINUES``).
    """
    open_at = F.col("open_offset") if "open_offset" in ranges.columns else F.lit(None).cast("bigint")
    needed = ranges.select(
        "file_key", "source", "severity", "path", "file_size", "start_offset", "range_start", "range_end",
        F.coalesce(open_at, F.col("file_size")).alias("open_offset"),
    )

    most = MOST_RECORD_BYTES

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with open_log(row["path"]) as f:
                    parts = read_range(
                        f, row["range_start"], row["range_end"], row["start_offset"], blocks, hold_open, row["file_size"], most=most
                    )
                    for offsets, records, continues in parts:
                        n = len(records)
                        fixed = [
                            pa.repeat(pa.scalar(row[c], t), n)
                            for c, t in (
                                ("file_key", pa.string()), ("source", pa.string()),
                                ("severity", pa.string()), ("range_start", pa.int64()),
                            )
                        ]
                        yield pa.RecordBatch.from_arrays(
                            [
                                *fixed, pa.array(offsets, pa.int64()), records,
                                pa.array(offsets >= row["open_offset"]), *continues_columns(continues, n),
                            ],
                            names=["file_key", "source", "severity", "range_start", "offset", "record", "is_open", *CONTINUES],
                        )

    return needed.mapInArrow(run, RECORD_SCHEMA)
