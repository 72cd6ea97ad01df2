"""Exact duplicates by a heavy-hitter split.

A Misra-Gries summary names the digests that may be frequent; their exact counts are then taken,
and that small table is broadcast, so the rows of frequent texts are decided where they are read.
All other digests are grouped by an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perfweave.llm.common import GAP, stage, table

# Counters of the summary: the most rows that are ever broadcast.
COUNTERS = 1024


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), GAP, " ")


def frequent(digests: DataFrame, counters: int) -> DataFrame:
    """At most ``counters`` digests with a count above 1: ``digest, keep_id, group_size``.

    Partial summaries are merged in two steps, so no task merges those of all others. A frequent
    digest that the summary misses is no error; it goes the ordinary way.
    """
    tracked = max(counters, 16)
    groups = digests.groupBy((F.spark_partition_id() % 64).alias("part")).agg(
        F.expr(f"approx_top_k_accumulate(digest, {tracked})").alias("summary")
    )
    whole = groups.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_combine(summary, {tracked})").alias("summary"))
    found = whole.select(F.explode(F.expr(f"approx_top_k_estimate(summary, {counters})")).alias("entry")).select(
        F.col("entry.item").alias("digest")
    )
    exact = digests.join(F.broadcast(found), "digest").groupBy("digest").agg(
        F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    return exact.filter("group_size > 1")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row for every row of ``docs``: ``id, keep_id, group_size, kept, digest``.

    Null text counts as empty; texts that differ in runs of white space only are equal. Null ids come
    after all others: such a row stays only when its whole group has none (``keep_id`` null). Rows that
    repeat the smallest id of their group are all marked as kept; ``drop_copies`` leaves one of them.
    """
    digests = stage(docs.select(
        F.col(text_col).alias("text"), F.col(id_col).alias("id")
    ).select("id", F.sha2(normalised(F.col("text")), 256).alias("digest")))
    heavy = stage(frequent(digests, counters))
    by_map = digests.join(F.broadcast(heavy), "digest")
    light = digests.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    groups = light.groupBy("digest").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    out = by_map.unionByName(light.join(groups, "digest"))
    return out.select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """``docs`` without copies: of equal texts one row with the smallest id stays, whole."""
    groups = exact_groups(docs, id_col, text_col, counters)
    keep = groups.filter("kept").groupBy("id", "digest").agg(F.count(F.lit(1)).alias("n"))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("row_id"),
        F.sha2(normalised(F.col(text_col)), 256).alias("row_digest"),
    )
    same = F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_digest") == F.col("digest"))
    once = rows.join(keep.filter("n = 1"), same, "left_semi")
    repeated = rows.join(keep.filter("n > 1"), same, "left_semi")
    one = repeated.groupBy("row_id", "row_digest").agg(F.first("row").alias("row"))
    return once.select("row.*").unionByName(one.select("row.*"))


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
