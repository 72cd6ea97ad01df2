"""Whole-table bounds and row counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounds(facts: DataFrame, ts: str) -> DataFrame:
    return facts.agg(F.min(ts).alias("earliest"), F.max(ts).alias("latest"))


def row_counts(named: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) for every given table, counted in one job."""
    parts = [
        df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
        for name, df in named.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def meta_row(named: dict[str, DataFrame], fact: str, ts: str, prefix: str, sources: list[str]) -> DataFrame:
    """One row: configured sources, bounds of ``fact``, default window end, row counts."""
    parts = [
        df.agg(
            F.lit(name).alias("name"),
            F.count(F.lit(1)).alias("n"),
            (F.min(ts) if name == fact else F.lit(None).cast("bigint")).alias("lo"),
            (F.max(ts) if name == fact else F.lit(None).cast("bigint")).alias("hi"),
        )
        for name, df in named.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts).agg(
        F.array(*[F.lit(s) for s in sources]).alias("sources"),
        F.min("lo").alias(f"earliest_{prefix}"),
        F.max("hi").alias(f"latest_{prefix}"),
        F.max("hi").alias("default_end"),
        *[F.max(F.when(F.col("name") == n, F.col("n"))).alias(f"{n}_rows") for n in named],
    )
