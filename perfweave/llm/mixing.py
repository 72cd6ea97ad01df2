"""Mixing sources to target weights.

Each document gets a hash-random key. The keys are cut into equal ranges within each source, sizes are
summed per range, and running sums over ranges and then inside each range give every document its
place on its source's line of words. The budget is a length on that line: whole rounds of the source,
then a cut at the exact word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perfweave.llm.common import bucket_count, stage, table, word_count, words_of

MOST_REPEATS = 3


def default_weight(place: Column) -> Column:
    """1, 2, 3 and again, by the source's place (from 0) in code-point order."""
    return (place % 3 + 1).cast("double")


def source_targets(sizes: DataFrame, weight=default_weight, most: int = MOST_REPEATS) -> DataFrame:
    """Target of each source from ``source, source_size``: one row per source.

    All sizes are shared out by weight. A target stops at ``most`` times its source's size and the
    excess is shared again by weight, until none is above: sources in the order of the level at which
    they fill up, the first level that fits all the rest (the largest that fits) is everyone's. Works on one row per source.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    placed = sizes.select("source", "source_size", weight(F.row_number().over(in_order) - 1).alias("weight"))
    levels = placed.withColumn("full_at", most * F.col("source_size") / F.col("weight")).select(
        "*",
        F.sum("source_size").over(every).alias("total"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("size_before"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("weight_left"),
    ).withColumn("level", (F.col("total") - most * F.col("size_before")) / F.col("weight_left"))
    fits = F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(every)
    return levels.select(
        "source", "source_size", "weight",
        F.least(most * F.col("source_size").cast("double"), F.coalesce(fits, F.col("full_at")) * F.col("weight")).alias("target"),
    )


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("key"), *more)


def _taken(rows: DataFrame, sizes: DataFrame, weight, most: int) -> DataFrame:
    """``rows`` with ``source_size, target, taken``, from ``sizes``, the same rows without what they carry."""
    targets = source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weight, most)
    buckets = bucket_count(sizes.count())
    bucket = F.floor(F.conv(F.substring("key", 1, 6), 16, 10).cast("long") * buckets / (1 << 24)).alias("bucket")
    sums = sizes.groupBy("source", bucket).agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("begin"))
    starts = stage(starts.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select(
        F.col("s.source").alias("from"), F.col("s.bucket").alias("range"), "s.begin", "t.source_size", "t.target"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.select("*", bucket).join(starts, F.col("source").eqNullSafe(F.col("from")) & (F.col("bucket") == F.col("range")))
    at = F.col("begin") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget = F.floor("target").cast("long")
    rounds = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    cut = budget - rounds * F.col("source_size") - F.col("at")
    taken = rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), cut))
    return joined.withColumn("at", at).withColumn("taken", taken.cast("long"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weight=default_weight, most: int = MOST_REPEATS) -> DataFrame:
    """What the mix takes of each row: ``id, source, size, source_size, target, taken``.

    A size is a number of words, 0 for null and empty texts, which are never taken. A null source is a
    source of its own, last in order. The key is the MD5 of the id, so reruns agree; rows with one id
    follow by size, and equal ones are interchangeable. A source's taken words are its target rounded
    down (a document on the cut gives its first words); no row gives more than ``most`` times its size.
    """
    rows = stage(_keyed(docs, id_col, text_col, source_col))
    return _taken(rows, rows, weight, most).select("id", "source", "size", "source_size", "target", "taken")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weight=default_weight, most: int = MOST_REPEATS) -> DataFrame:
    """The mixed documents, with the columns of ``docs``: a row for each whole repeat, and for the document
    on a source's cut one with its first words, joined by one space."""
    sizes = stage(_keyed(docs, id_col, text_col, source_col))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = _taken(_keyed(docs, id_col, text_col, source_col, row), sizes, weight, most).filter("taken > 0")
    repeats = rows.withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("taken") / F.col("size")) - 1)))
    left = F.col("taken") - F.col("round") * F.col("size")
    whole = F.col("row").getField(text_col)
    text = F.when(left >= F.col("size"), whole).otherwise(F.array_join(F.slice(words_of(whole), F.lit(1), left.cast("int")), " "))
    return repeats.select(*[text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "source_size", F.round("target", 6).alias("target"), "taken")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight
  FROM d GROUP BY source
), f AS (
  SELECT *, 3 * source_size / weight AS full_at, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight FROM s
), l AS (
  SELECT *, CAST(total - 3 * coalesce(sum(source_size) OVER b, 0) AS DOUBLE) / (all_weight - coalesce(sum(weight) OVER b, 0)) AS level
  FROM f WINDOW b AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size,
         least(3.0::DOUBLE * source_size, coalesce((SELECT max(level) FROM l WHERE level <= full_at), full_at) * weight) AS target
  FROM l
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       CASE WHEN source_size = 0 THEN 0 ELSE
         budget // source_size * size + greatest(0, least(size, budget % source_size - place)) END AS taken
FROM p
"""
