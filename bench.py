"""Headline timings: import of log files, parsing, and read queries. Prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from checks import registered as r
from perfweave.operators.parse_cpu import block_stats, identified, parse_blocks
from perfweave.operators.parse_slow import parse_slow
from perfweave.plans import cpu, slow
from perfweave.plans import sample_views as views
from perfweave.plans.ingest import import_logs, rebuild_rollups
from perfweave.plans.store import open_store, scratch_dir

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("perfweave-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name: str, run, repeat: int = 1):
        """Best of ``repeat`` runs."""
        best, out = None, None
        for _ in range(repeat):
            began = time.perf_counter()
            out = run()
            took = time.perf_counter() - began
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
        print(f"{name:28s} {best:8.3f}", file=sys.stderr, flush=True)
        return out

    def drain(df):
        df.write.format("noop").mode("overwrite").save()

    logs = r._log_dir(spark, SF_DIR)  # writing the input is not timed
    log_bytes = r.total_log_bytes(r._files(spark, SF_DIR)).first()["total_bytes"]

    timed("parse_slow", lambda: drain(parse_slow(r._records(spark, SF_DIR, False), "record")), 2)
    timed("parse_cpu", lambda: drain(block_stats(identified(parse_blocks(r._records(spark, SF_DIR, True))))), 2)

    def load():
        store = open_store(spark, f"{scratch_dir(spark)}/store")
        import_logs(spark, logs, store, r.NOW, views.TEXT_CONFIG)
        return store

    store = timed("import", load, 2)
    timed("import_nothing_new", lambda: import_logs(spark, logs, store, r.NOW, views.TEXT_CONFIG))
    timed("rebuild_rollups", lambda: rebuild_rollups(store), 2)

    tables, config = store.tables(), views.TEXT_CONFIG
    end = views.TEXT_START + 30 * 86400
    busiest = tables.cpu_stats.groupBy("description_id").count().orderBy(F.desc("count"), "description_id").first()[0]
    owner = tables.descriptions.filter(F.col("description_id") == busiest).first()["source"]
    reads = {
        "header_overview": lambda m: cpu.header_overview(tables, "urgent", end, "30d", m, config),
        "source_usage": lambda m: cpu.source_usage(tables, "high", end, "30d", m, config),
        "cpu_top": lambda m: cpu.top_functions(tables, "high", end, "30d", "total", 50, m, config),
        "slow_overview": lambda m: slow.overview(tables, "click", end, "30d", m, config),
        "slow_top": lambda m: slow.top_functions(tables, "click", end, "30d", "count", 50, m, config),
        "slow_comparison": lambda m: slow.comparison(tables, "click", end, "14d", m, config),
    }
    for name, query in reads.items():
        for mode in ("raw", "rollup"):
            timed(f"{name}_{mode}", lambda q=query, m=mode: q(m).collect(), 3)
    timed("cpu_series", lambda: cpu.function_series(tables, busiest, owner, end, "30d", config).collect(), 3)

    for name in ("slow_overview_raw", "cpu_top_total", "source_usage_raw", "rollup_cpu_function", "dedup_cpu"):
        timed(f"tables_{name}", lambda n=name: drain(r.all_queries()[n](spark, SF_DIR)), 3)

    print(json.dumps({
        "metric": "total_wall_time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "log_mb": round(log_bytes / 1e6, 1),
        "import_mb_per_sec": round(log_bytes / 1e6 / times["import"], 2),
        "parse_mb_per_sec": round(log_bytes / 1e6 / (times["parse_slow"] + times["parse_cpu"]), 2),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
