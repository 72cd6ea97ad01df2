"""Tables on shared storage: Parquet, a folder per table and import run, partitioned by date.

A run's folders are invisible until its record is in the commit log (``commits``); a run that died or lost
the race for its number leaves folders nobody reads. A record names the folder, the tables that have rows
with their days, and the latest times by stream, so readers and planners need no look at the facts.

Nothing is ever overwritten. Rollups are partial aggregates per run, merged when read; the import state
is a row per file and run, of which the latest counts.

The end of a growing file may hold an unfinished record. What has been read of it is stored in tables of
its own (``open_...``) and counts until a later run reads the file on from that record's start.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from datetime import date
from threading import Lock
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perfweave import schemas
from perfweave.operators import rollups
from perfweave.plans.commits import CommitLog, day
from perfweave.tables import LogTables

T_ = TypeVar("T_")

FACTS = ("slow_events", "cpu_reports", "cpu_stats")
_OPEN = {f"open_{t}": schemas.opened(s) for t, s in (
    ("slow_events", schemas.SLOW_EVENTS), ("cpu_reports", schemas.CPU_REPORTS), ("cpu_stats", schemas.CPU_STATS),
)}
_RUN_TABLES = {
    "descriptions": schemas.DESCRIPTIONS,
    "cpu_reports": schemas.CPU_REPORTS,
    "cpu_stats": schemas.CPU_STATS,
    "slow_events": schemas.SLOW_EVENTS,
    "import_files": schemas.STORED_FILES,
    "ingest_audit": schemas.INGEST_AUDIT,
    "quarantine": schemas.QUARANTINE,
    **schemas.PARTIALS,
    **_OPEN,
}
# Columns of a fact that tell when it happened.
TIME = {"slow_events": "occurred_at", "cpu_reports": "reported_at", "cpu_stats": "reported_at"}


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder for intermediate tables and checkpoints, on the cluster's shared storage."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/perfweave-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="perfweave-")


def stage(df: DataFrame, path: str) -> DataFrame:
    """Writes ``df`` and reads it back: cuts the lineage and computes it once.

    Log text takes half the disk under zstd that it takes under Parquet's usual codec.
    """
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_together(jobs: list[Callable[[], T_]]) -> list[T_]:
    """Runs independent Spark jobs at the same time, so small ones do not wait for each other."""
    with ThreadPoolExecutor(max_workers=len(jobs)) as pool:
        return [f.result() for f in [pool.submit(job) for job in jobs]]


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of intermediate tables."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# By session: how many ask for it now, and what was set before the first of them.
_removing: dict[str, tuple[int, str]] = {}
_removing_lock = Lock()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within, a query's shuffle files are removed when it ends, not when the driver happens to collect its garbage.

    A job of many queries so needs the disk of its largest, not of all of them.
    """
    session = spark._jsparkSession.sessionUUID()
    with _removing_lock:
        users, before = _removing.get(session) or (0, spark.conf.get(_REMOVE_SHUFFLES, "false"))
        _removing[session] = users + 1, before
        spark.conf.set(_REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        with _removing_lock:
            users, before = _removing.pop(session)
            if users > 1:
                _removing[session] = users - 1, before
            else:
                spark.conf.set(_REMOVE_SHUFFLES, before)


class Store:
    """Reads and writes the tables under one root folder."""

    def __init__(self, spark: SparkSession, root: str, as_of: int | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.log = CommitLog(spark, f"{self.root}/runs", as_of)

    def scratch(self) -> str:
        """A folder for a run's intermediate tables; the run removes it."""
        return f"{self.root}/_scratch/{uuid.uuid4().hex}"

    # Runs

    def committed(self) -> list[int]:
        return [r["run"] for r in self.log.records()]

    def has_mark(self, mark: str) -> bool:
        """Whether a run carries ``mark``: what it stored is not to be stored again."""
        return any(mark in r["marks"] for r in self.log.records())

    def has_moved_names(self) -> bool:
        """Whether a name has another id than its own hash."""
        return any(r.get("moved_names") for r in self.log.records())

    def folder(self, number: int) -> str:
        """A folder name for an attempt at run ``number``; names sort as runs do."""
        return f"{number:012d}-{uuid.uuid4().hex}"

    def commit(self, number: int, folder: str, tables: dict[str, dict], at: int, **more) -> bool:
        """Makes a run's folder part of the store, if no other run has that number."""
        record = {"folder": folder, "at": at, "marks": [], "tables": tables, **more}
        return self.log.claim(number, record)

    def _holding(self, table: str, since: date | None = None, records: list[dict] | None = None) -> list[dict]:
        """Records of runs with rows of ``table``, on or after the day ``since``."""
        found = [r for r in (self.log.records() if records is None else records) if table in r["tables"]]
        if table in schemas.PARTIALS:
            anew = max((r["run"] for r in found if r.get("rebuilt")), default=0)
            found = [r for r in found if r["run"] >= anew and r["tables"][table]["rows"]]
        if since is None:
            return found
        return [r for r in found if (last := day(r["tables"][table]["last_day"])) is None or last >= since]

    # Tables

    def read_folders(self, table: str, folders: list[str]) -> DataFrame:
        """Rows of ``table`` in the given folders, with the folder in column ``run``."""
        schema = T.StructType([*_RUN_TABLES[table].fields, T.StructField("run", T.StringType())])
        if not folders:
            return self.spark.createDataFrame([], schema)
        base = f"{self.root}/{table}"
        return self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/run={f}" for f in folders])

    def _closed(self, table: str, since: date | None = None, records: list[dict] | None = None) -> DataFrame:
        folders = [r["folder"] for r in self._holding(table, since, records)]
        return self.read_folders(table, folders).drop("run")

    def closed(self, table: str, since: date | None = None) -> DataFrame:
        """Finished rows of all committed runs; runs without a row since that day are not opened."""
        return self._closed(table, since)

    def open_rows(self, table: str, records: list[dict] | None = None) -> DataFrame | None:
        """What has been read of records still open, with file_key; None if there are none.

        They count while their run is the last one to have read the file.
        """
        records = self.log.records() if records is None else records
        holding = self._holding(f"open_{table}", None, records)
        if not holding:
            return None
        rows = self.read_folders(f"open_{table}", [r["folder"] for r in holding])
        later = [r for r in self._holding("import_files", None, records) if r["run"] >= holding[0]["run"]]
        last = self.read_folders("import_files", [r["folder"] for r in later]).groupBy("file_key").agg(F.max("run").alias("_last"))
        return rows.join(last, "file_key").filter("run = _last").drop("run", "_last")

    def read(self, table: str) -> DataFrame:
        """Rows of the committed runs, with those of records still open."""
        return self._read(table, self.log.records())

    def _read(self, table: str, records: list[dict]) -> DataFrame:
        if table in schemas.ROLLUPS:
            return self._read_rollup(table, records)
        closed = self._closed(table, None, records)
        opened = self.open_rows(table, records) if table in FACTS else None
        return closed if opened is None else closed.unionByName(opened.select(*closed.columns))

    def state(self) -> DataFrame:
        """Import state: the latest row of every file."""
        rows = self.read_folders("import_files", [r["folder"] for r in self._holding("import_files")])
        names = _RUN_TABLES["import_files"].names
        latest = rows.groupBy("file_key").agg(F.max(F.struct("run", *names)).alias("_s"))
        return latest.select(*[F.col(f"_s.{c}").alias(c) for c in names])

    def read_latest(self, table: str) -> DataFrame:
        """The import state, or the rows that the last run wrote."""
        if table == "import_files":
            return self.state()
        return self._closed(table, None, self.log.records()[-1:])

    def high_water(self) -> DataFrame:
        """Latest finished time by stream: one row per configured source and severity, from the log."""
        return self.spark.createDataFrame(self._marks(self.log.records()), schemas.HIGH_WATER)

    @staticmethod
    def _marks(records: list[dict]) -> list[tuple]:
        latest: dict[tuple, int] = {}
        for r in records:
            for source, severity, ts in r.get("high_water", []):
                latest[source, severity] = max(ts, latest.get((source, severity), ts))
        return [(*k, v) for k, v in latest.items()]

    def write(
        self, table: str, folder: str, df: DataFrame, sort_by: tuple[str, ...] = (), by_source: bool = False
    ) -> dict[str, dict]:
        """Writes one table of a run; returns what the record says of it, nothing for an empty one.

        Dated tables are clustered by day before writing, and with ``by_source`` (for runs large
        enough that a day fills many files) by source too. AQE gives a dominant day or source
        several tasks and folds small ones together; the sort lets Parquet min/max values skip by
        source, function and time.
        """
        schema = _RUN_TABLES[table]
        path = f"{self.root}/{table}/run={folder}"
        df, dated = df.select(*schema.names), "event_date" in schema.names
        if dated:
            cluster = ("event_date", "source") if by_source else ("event_date",)
            df = df.hint("rebalance", *cluster).sortWithinPartitions("event_date", "source", *sort_by)
            df.write.mode("overwrite").partitionBy("event_date").parquet(path)
        elif table == "descriptions":
            # By ranges of id, so that a look-up opens one file of a run; the filter spares it where the id is not in.
            by_id = df.repartitionByRange("description_id").sortWithinPartitions("description_id")
            by_id.write.mode("overwrite").option("parquet.bloom.filter.enabled#description_id", "true").parquet(path)
        else:
            df.write.mode("overwrite").parquet(path)
        # From the folder's listing, the files' footers and one column.
        ts, none = TIME.get(table.removeprefix("open_")), F.lit(None)
        seen = self.read_folders(table, [folder]).agg(
            F.count(F.lit(1)).alias("rows"),
            (F.min("event_date") if dated else F.max(none)).cast("string").alias("first_day"),
            (F.max("event_date") if dated else F.max(none)).cast("string").alias("last_day"),
            (F.max(ts) if ts else F.max(none)).cast("long").alias("latest"),
        ).first().asDict()
        return {table: seen} if seen["rows"] else {}

    def write_run(self, table: str, run: int, df: DataFrame) -> dict[str, dict]:
        return self.write(table, self.folder(run), df)

    # Rollups

    def read_rollup(self, name: str) -> DataFrame:
        return self._read_rollup(name, self.log.records())

    def _read_rollup(self, name: str, records: list[dict]) -> DataFrame:
        """The runs' partial aggregates merged, with what records still open add to them."""
        parts = self._closed(name, None, records)
        opened = {t: self.open_rows(t, records) for t in FACTS}
        if any(df is not None for df in opened.values()):
            facts = [opened[t] if opened[t] is not None else self.read_folders(t, []) for t in ("cpu_reports", "cpu_stats", "slow_events")]
            parts = parts.unionByName(rollups.partials(*facts)[name].select(*parts.columns))
        return rollups.merged(name, parts).select(*schemas.ROLLUPS[name].names)

    def write_partials(
        self, folder: str, reports: DataFrame, stats: DataFrame, events: DataFrame, kept: dict[str, DataFrame] | None = None
    ) -> dict[str, dict]:
        """Writes partial aggregates of the given facts, together with parts ``kept`` as they are."""
        frames = rollups.partials(reports, stats, events)

        def write(name: str) -> dict[str, dict]:
            names = schemas.PARTIALS[name].names
            frame = frames[name].select(*names)
            if kept:
                frame = frame.unionByName(kept[name])
            return self.write(name, folder, frame, tuple(c for c in ("description_id", "bucket_time") if c in names))

        return {k: v for one in run_together([lambda n=n: write(n) for n in frames]) for k, v in one.items()}

    def latest_times(self, records: list[dict]) -> dict[str, int]:
        """Latest time of each fact, finished or open, from the log."""
        found: dict[str, int] = {}
        for r in records:
            for table, seen in r["tables"].items():
                fact = table.removeprefix("open_")
                if fact in FACTS and seen.get("latest") is not None:
                    found[fact] = max(seen["latest"], found.get(fact, seen["latest"]))
        return found

    def tables(self) -> LogTables:
        """Everything a read query needs, of the store as it is now."""
        records = self.log.records()
        rolled = {
            n: self._read_rollup(n, records) if self._holding(n, None, records) else None for n in schemas.ROLLUPS
        }
        facts = {t: self._read(t, records) for t in ("descriptions", *FACTS)}
        streams = self._marks(records)
        return LogTables(
            **facts, **rolled, ends=self.latest_times(records),
            rolled_sources={
                "slow": frozenset(s for s, severity, _ in streams if severity is not None),
                "cpu": frozenset(s for s, severity, _ in streams if severity is None),
            },
        )


def open_store(spark: SparkSession, root: str, as_of: int | None = None) -> Store:
    """The store under ``root``, or read-only as it was after run ``as_of``."""
    if "://" not in root and not root.startswith("file:"):
        root = os.path.abspath(root)
    return Store(spark, root, as_of)
