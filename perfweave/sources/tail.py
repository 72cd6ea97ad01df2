"""Streaming source for logs that grow in place.

Spark's own file stream takes files as finished. Here the stream position of a file is a byte
offset with the fingerprints of its first line and of the last bytes before the offset, so appended
bytes are read once, a replaced file is read again from its start, and an unfinished record waits for
its end. The bytes between two positions are cut into ranges that tasks read independently.

With a byte limit the position cannot be told from the files. It is the one that Spark has written to
the query's checkpoint, and no other copy is kept, so the two cannot differ.
"""

from __future__ import annotations

import hashlib
import json
import sys

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from perfweave.config import EngineConfig
from perfweave.sources import ranges
from perfweave.sources.catalog import classify_files

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bytes before a position that tell whether the file is still the one that was read.
LAST_BYTES = 256

TAIL_SCHEMA = f"file_key STRING, offset BIGINT, record BINARY, {ranges.CONTINUES_SCHEMA}"


class _Range(InputPartition):
    def __init__(self, name: str, path: str, start: int, end: int, base: int, size: int):
        self.name, self.path = name, path
        self.start, self.end, self.base, self.size = start, end, base, size


def _holds_blocks(name: str) -> bool:
    return "_slow" not in name


def last_bytes_hash(f, at: int) -> str:
    """sha256 of the bytes just before ``at``."""
    start = max(0, at - LAST_BYTES)
    f.seek(start)
    return hashlib.sha256(f.read(at - start)).hexdigest()


def planned_position(checkpoint: str) -> dict:
    """End of the last batch that Spark planned for a query with this one source; empty before the first.

    A batch that was planned and not finished is run again up to the same end, so reading goes on there.
    """
    fs, path = ranges.file_system(checkpoint)
    files = fs.get_file_info(pafs.FileSelector(f"{path}/offsets", allow_not_found=True))
    batches = [i for i in files if i.type == pafs.FileType.File and i.base_name.isdigit()]
    if not batches:
        return {}
    with fs.open_input_stream(max(batches, key=lambda i: int(i.base_name)).path) as f:
        # Spark's log: a version, the batch's metadata, then a line for each source.
        lines = f.read().decode().splitlines()
    return {} if len(lines) < 3 or lines[2] == "-" else json.loads(lines[2])


def _goes_on(path: str, before: dict | None, to: dict) -> bool:
    """Whether ``to`` is a later position in the file that ``before`` was in.

    A reader that does not know the checkpoint cannot tell a rewritten file by itself; the bytes before the
    old position do.
    """
    if not before or before["first"] != to["first"] or before.get("life", 0) != to.get("life", 0) or to["at"] < before["at"]:
        return False
    if "last" not in before:
        return True
    with ranges.open_log(path) as f:
        return last_bytes_hash(f, before["at"]) == before["last"]


class _TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangeBytes", 128 * 1024 * 1024))
        self.max_bytes = int(options.get("maxBytesPerBatch", 0))
        self.finalize = options.get("finalize", "false").lower() == "true"
        self.cutoff = int(options["cutoff"]) if "cutoff" in options else None
        self.log_tz = options.get("logTz", "UTC")
        # Only files that grow at their end are surely in time order.
        self.rolling = frozenset(json.loads(options.get("rolling", "[]")))
        self.checkpoint = options.get("checkpoint")
        self.seen: dict | None = None
        self.known: dict = {}
        self.turn = 0

    def initialOffset(self) -> dict:
        return {}

    def _finished(self, fs, info, old: dict | None) -> tuple[str | None, int, bool]:
        """First line's hash, end of the last finished record, and whether this is another file than before.

        Files that have not changed since the last look are not opened.
        """
        state = (info.size, info.mtime_ns)
        if self.known.get(info.path, (None,))[0] != state:
            with fs.open_input_file(info.path) as f:
                first = ranges.first_line_hash(f)
                end = info.size if self.finalize else ranges.open_tail_offset(f, info.size, 0, _holds_blocks(info.base_name))
                other = bool(old) and (
                    old["first"] != first or info.size < old["at"]
                    or "last" in old and last_bytes_hash(f, old["at"]) != old["last"]
                )
            self.known[info.path] = (state, first, end)
            return first, end, other
        return *self.known[info.path][1:], False

    def _step(self, fs, info, at: int, end: int, left: int) -> int:
        """End of the whole records from ``at`` that ``left`` bytes hold; the first one's if a fresh limit holds none."""
        blocks = _holds_blocks(info.base_name)
        with fs.open_input_file(info.path) as f:
            cut = ranges.open_tail_offset(f, at + left, at, blocks)
            if cut > at or left < self.max_bytes:
                return cut
            for _, records, continues in ranges.read_range(f, at, at + 1, at, blocks, limit=end):
                at += len(records[0].as_py()) - (continues[1] if continues else 0)
            return at

    def latestOffset(self) -> dict:
        """Position of every log up to its last finished record.

        With ``maxBytesPerBatch`` all files together advance by that many bytes at most, in whole records;
        a longer record is a step of its own. Files take turns in coming first.
        """
        fs, base = ranges.file_system(self.folder)
        if self.seen is None:
            self.seen = planned_position(self.checkpoint) if self.checkpoint else {}
        left = self.max_bytes
        logs = sorted(
            (i for i in fs.get_file_info(pafs.FileSelector(base))
             if i.type == pafs.FileType.File and i.base_name.endswith(".log") and i.size),
            key=lambda i: i.path,
        )
        turn = self.turn % max(1, len(logs))
        self.turn += 1
        now = {}
        for info in logs[turn:] + logs[:turn]:
            old = self.seen.get(info.base_name)
            first, end, other = self._finished(fs, info, old)
            if first is None:
                continue
            at = old["at"] if old and not other else 0
            end = max(end, at)
            if self.max_bytes:
                if end - at > left:
                    end = self._step(fs, info, at, end, left) if left > 0 else at
                left -= end - at
            if old and not other and end == at:
                now[info.base_name] = old
            elif end or old:
                # A file's life ends when another file takes its name.
                life = (old.get("life", 0) if old else 0) + other
                with fs.open_input_file(info.path) as f:
                    now[info.base_name] = {"first": first, "at": end, "life": life, "last": last_bytes_hash(f, end)}
        self.seen = {**self.seen, **now}
        return self.seen

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        out = []
        for name, to in end.items():
            before, path = start.get(name), f"{self.folder.rstrip('/')}/{name}"
            if before == to:
                continue
            base = before["at"] if _goes_on(path, before, to) else 0
            for lo in range(base, to["at"], self.range_bytes):
                hi = min(lo + self.range_bytes, to["at"])
                out.append(_Range(name, path, lo, hi, base, to["at"]))
        return out

    def read(self, part: _Range):
        with ranges.open_log(part.path) as f:
            if self.cutoff is not None and part.name in self.rolling and part.end < part.size:
                # In a time-sorted log everything here is older than what follows.
                following = ranges.first_stamp(f, part.end, part.size, self.log_tz)
                if following is not None and following[0] < self.cutoff:
                    return
            for offsets, records, continues in ranges.read_range(
                f, part.start, part.end, part.base, _holds_blocks(part.name), limit=part.size
            ):
                names = pa.repeat(pa.scalar(part.name), len(records))
                yield pa.RecordBatch.from_arrays(
                    [names, pa.array(offsets, pa.int64()), records, *ranges.continues_columns(continues, len(records))],
                    names=["file_key", "offset", "record", *ranges.CONTINUES],
                )


class LogTail(DataSource):
    """``spark.readStream.format("log_tail").option("path", folder)``."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return TAIL_SCHEMA

    def streamReader(self, schema) -> _TailReader:
        return _TailReader(self.options)


def tail_logs(
    spark: SparkSession,
    data_dir: str,
    config: EngineConfig,
    finalize: bool = False,
    cutoff: int | None = None,
    max_bytes: int = 0,
    checkpoint: str | None = None,
) -> DataFrame:
    """Stream of raw records with source, type and severity from the file name.

    ``max_bytes`` limits a micro-batch. It needs the ``checkpoint`` that the query will be started with, from
    which the position is taken; the stream must be that query's only source. Under ``availableNow`` Spark
    asks a Python source for one batch, so a run is one step then.
    """
    if max_bytes and checkpoint is None:
        raise ValueError("max_bytes needs the query's checkpoint")
    if any("_slow" in s for s in config.sources):
        raise ValueError("source names containing '_slow' cannot be tailed")
    spark.dataSource.register(LogTail)
    reader = (
        spark.readStream.format("log_tail")
        .option("path", data_dir)
        .option("rangeBytes", config.range_bytes)
        .option("maxBytesPerBatch", max_bytes)
        .option("finalize", str(finalize).lower())
        .option("logTz", config.log_tz)
        .option("rolling", json.dumps([s + end for s in config.sources for end in (".log", "_slow.log", "_very_slow.log")]))
    )
    if checkpoint is not None:
        reader = reader.option("checkpoint", checkpoint)
    if cutoff is not None:
        reader = reader.option("cutoff", cutoff)
    return classify_files(reader.load(), config)
