"""Benchmark decontamination by SimHash windows.

A window of a document has as many word shingles as an item, and is cut where it would begin before the
document or end after it. Every window that shares a shingle with an item of its size is fingerprinted, wherever
the shingle stands in either: the other windows have similarity 0. Fingerprints roll: a window's bit counters
are the running sums at its end less those before its start. Fingerprints of windows and items of one size meet
in a multi-index: each of eight blocks of a fingerprint, with up to two bits flipped, so every pair within radius
23 meets (23 errors leave a block with at most two). Pairs within the radius are verified by the exact similarity
of their shingles, weighted by how often each occurs.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from perfweave.llm.common import GAP, SHINGLE_WORDS, stage, table

SIMILARITY = 0.75
RADIUS = 23
# Most rows (of 12 to 40 bytes) of an item table that is broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS = 500_000
# Places of windows that a task takes, about.
PLACES_PER_TASK = 100_000

_HALVES = 0x0000000100000001
_FLIPS = [0, *[1 << b for b in range(8)], *[1 << a | 1 << b for a, b in combinations(range(8), 2)]]


def lowered_words(text: Column) -> Column:
    """Lower-cased words, in order; one empty word for a text without any."""
    return F.split(F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\x0c\r")), GAP)


def shingle_at(words: Column, at: Column) -> Column:
    """Hash of the five words from place ``at`` (from 0) on."""
    return F.xxhash64(F.slice(words, at + 1, F.lit(SHINGLE_WORDS)))


def shingle_places(words: Column) -> Column:
    """The places where five words begin; null where there are fewer."""
    return F.when(F.size(words) >= SHINGLE_WORDS, F.sequence(F.lit(0), F.size(words) - SHINGLE_WORDS))


def with_shingles(rows: DataFrame) -> DataFrame:
    """``words`` replaced by the hashes of their ``shingles``. For few rows: windows and items."""
    return rows.withColumn("shingles", F.transform(shingle_places(F.col("words")), lambda i: shingle_at(F.col("words"), i))).drop("words")


def row_key(*columns: str) -> Column:
    """128 bits for the values of a row."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b"))


def bit_counters(shingle: str) -> list[Column]:
    """The 64 bits of a hash as addends: two bits' counters each, in the two halves of a number."""
    return [F.shiftrightunsigned(shingle, k).bitwiseAND(F.lit(_HALVES)).alias(f"s{k}") for k in range(32)]


def majority(n: Column) -> Column:
    """The fingerprint from summed counters ``s0`` to ``s31``: a bit is set if more than half of ``n`` shingles have it."""
    value = F.lit(0).cast("bigint")
    for k in range(32):
        low, high = F.col(f"s{k}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col(f"s{k}"), 32)
        for count, bit in ((low, k), (high, k + 32)):
            mask = (1 << bit) - (1 << 64 if bit == 63 else 0)
            value = value.bitwiseOR(F.when(count * 2 > n, F.lit(mask).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return value


def with_simhash(rows: DataFrame, keys: list[str], shingles: str) -> DataFrame:
    """``rows`` (one for each value of ``keys``) with a 64-bit ``fingerprint`` of their shingles; each occurrence counts."""
    each = rows.select(*keys, F.explode(shingles).alias("h")).select(*keys, *bit_counters("h"))
    sums = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"s{k}").alias(f"s{k}") for k in range(32)])
    return rows.join(sums.select(*keys, majority(F.col("n")).alias("fingerprint")), keys)


def block(fingerprint: Column, i: int) -> Column:
    return F.shiftrightunsigned(fingerprint, 8 * i).bitwiseAND(F.lit(255)).cast("int")


def weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of the smaller over sum of the larger counts of each shingle."""
    count = lambda items, x: F.size(F.filter(items, lambda y: y == x))
    shared = F.aggregate(
        F.array_distinct(F.array_intersect(a, b)), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))
    return shared / (F.size(a) + F.size(b) - shared)


def benchmark_items(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, shingles, fingerprint`` of the items of five words or more."""
    words = stage(items.select(F.col(id_col).alias("item_id"), lowered_words(F.col(text_col)).alias("words")).filter(
        F.size("words") >= SHINGLE_WORDS))
    grams = with_shingles(words).withColumn("item_key", F.xxhash64("item_id", "shingles")).dropDuplicates(["item_key"])
    return with_simhash(stage(grams), ["item_key"], "shingles")


def shared_places(rows: DataFrame, sizes: DataFrame, few: bool) -> DataFrame:
    """``id, row_key, length, last, place, shingle``: the places of all windows that hold a shingle of ``sizes``.

    ``rows`` has ``id, row_key, words``, ``sizes`` has ``shingle, length``; ``last`` is a document's last place.
    """
    every = rows.select("*", F.explode(shingle_places(F.col("words"))).alias("at"))
    if few:
        hits = every.withColumn("shingle", shingle_at(F.col("words"), F.col("at"))).join(F.broadcast(sizes), "shingle")
    else:  # keys alone are shuffled, then the words of documents with hits
        keys = every.select("row_key", "at", shingle_at(F.col("words"), F.col("at")).alias("shingle")).join(sizes, "shingle")
        of_row = keys.groupBy("row_key").agg(F.collect_set(F.struct("at", "length")).alias("hits"))
        hits = rows.join(of_row, "row_key").select("id", "row_key", "words", F.inline("hits"))
    last = F.size("words") - SHINGLE_WORDS
    reach = F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("length") + 1), F.least(last, F.col("at") + F.col("length") - 1))
    near = hits.select("id", "row_key", "length", "words", last.alias("last"), F.explode(reach).alias("place"))
    return near.groupBy("id", "row_key", "length", "last", "place").agg(
        F.max(shingle_at(F.col("words"), F.col("place"))).alias("shingle"))


def rolled_windows(places: DataFrame, similarity: float) -> DataFrame:
    """``id, row_key, length, start, end, first, fingerprint`` of all windows whose places are all there.

    A place adds the running sums up to it to the windows that end there, and takes those before it from the
    windows that begin there. ``first`` is the rank of ``start`` among the document's places for this length.
    A window cut to less than ``similarity`` of its length cannot be that similar and is left out.
    """
    names = [f"s{k}" for k in range(32)]
    so_far = Window.partitionBy("row_key", "length").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    keys = ["id", "row_key", "length", "last", "place"]
    each = places.select(*keys, F.lit(1).cast("bigint").alias("n"), *bit_counters("shingle"))
    running = each.select(*keys, F.lit(1).alias("one"), *[F.col(c).alias(f"own_{c}") for c in names], *[
        F.sum(c).over(so_far).alias(c) for c in ["n", *names]])
    place, length, last = F.col("place"), F.col("length"), F.col("last")
    least = F.ceil(F.lit(similarity) * length).cast("int")
    none = F.array().cast("array<int>")
    between = lambda a, b: F.when(a <= b, F.sequence(a, F.greatest(a, b))).otherwise(none)
    # Ends of the windows that begin here, and starts of those that end here; the cut ones among them belong to the document's ends.
    cut_ends = F.when(place == 0, between(least - 1, F.least(length - 2, last - 1))).otherwise(none)
    cut_starts = F.when(place == last, between(F.greatest(F.lit(1), last - length + 2), last - least + 1)).otherwise(none)
    ends = F.concat(F.array(F.least(place + length - 1, last)), cut_ends)
    starts = F.concat(F.array(F.greatest(place - length + 1, F.lit(0))), cut_starts)
    begin = F.transform(ends, lambda e: F.struct(place.alias("start"), e.alias("end"), F.lit(True).alias("begins")))
    finish = F.transform(starts, lambda s: F.struct(s.alias("start"), place.alias("end"), F.lit(False).alias("begins")))
    parts = running.select("*", F.inline(F.concat(begin, finish))).filter(F.col("end") - F.col("start") + 1 >= least)
    signed = lambda c, own: F.sum(F.when(F.col("begins"), own - F.col(c)).otherwise(F.col(c))).alias(c)
    sums = parts.groupBy("id", "row_key", "length", "start", "end").agg(
        F.max(F.when(F.col("begins"), F.col("n"))).alias("first"), F.count(F.when(~F.col("begins"), 1)).alias("finished"),
        signed("n", F.col("one")), *[signed(c, F.col(f"own_{c}")) for c in names])
    size = F.col("end") - F.col("start") + 1
    whole = sums.filter(F.col("first").isNotNull() & (F.col("finished") > 0) & (F.col("n") == size))
    return whole.select("id", "row_key", "length", "start", "end", F.col("first").cast("int").alias("first"), majority(size).alias("fingerprint"))


def blocks(fingerprint: str) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("block"), block(F.col(fingerprint), i).alias("value")) for i in range(8)])


def held_windows(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
                 item_text_col: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """``id, row_key, item_key, item_id, start, n_words, similarity``: all windows of an item's size that hold the item.

    ``start`` counts words from 0. Null and short texts have no windows; items of fewer than five words
    are not searched for, nor are null ones. Rows that repeat id and text are one document, with one ``row_key``.
    """
    known = stage(benchmark_items(items, item_id_col, item_text_col))
    sizes = stage(known.select(F.explode("shingles").alias("shingle"), F.size("shingles").alias("length")).distinct())
    rows = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row_key"), lowered_words(F.col(text_col)).alias("words"))
    places = stage(shared_places(rows, sizes, sizes.count() <= BROADCAST_ROWS))
    # A stated number of tasks: few bytes, but much work in each.
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, places.count() // PLACES_PER_TASK)
    placed = places.repartition(parts, "row_key", "length")
    windows = rolled_windows(placed, similarity)
    near = stage(known.select("item_key", F.size("shingles").alias("length"), F.col("fingerprint").alias("item_fingerprint"), F.inline(blocks("fingerprint"))).select(
        "item_key", "length", "item_fingerprint", "block", F.explode(F.transform(F.array(*[F.lit(f) for f in _FLIPS]), lambda f: F.col("value").bitwiseXOR(f))).alias("value")))
    side = F.broadcast(near) if near.count() <= BROADCAST_ROWS else near
    met = windows.select("*", F.inline(blocks("fingerprint"))).join(side, ["length", "block", "value"]).filter(
        F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint"))) <= radius)
    pairs = stage(met.groupBy("id", "row_key", "length", "start", "end", "first", "item_key").agg(F.count(F.lit(1)).alias("blocks")))
    texts = placed.groupBy("row_key", "length").agg(F.array_sort(F.collect_list(F.struct("place", "shingle")))["shingle"].alias("shingles"))
    held = pairs.repartition(parts, "row_key", "length").join(texts, ["row_key", "length"]).select(
        "id", "row_key", "item_key", "start", "end", F.slice("shingles", F.col("first"), F.col("end") - F.col("start") + 1).alias("window"))
    verified = held.join(known.select("item_key", "item_id", F.col("shingles").alias("item")), "item_key").withColumn(
        "similarity", weighted_similarity(F.col("window"), F.col("item"))).filter(F.col("similarity") >= similarity)
    return verified.select("id", "row_key", "item_key", "item_id", "start", (F.size("window") + SHINGLE_WORDS - 1).alias("n_words"), "similarity")


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
          item_text_col: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """``id, row_key, item_id, start, n_words, similarity``: the places of a document that hold an item.

    Of ``held_windows`` that follow each other word by word the most similar one stands for the place, of equal ones the first.
    """
    held = held_windows(docs, items, id_col, text_col, item_id_col, item_text_col, similarity, radius)
    # Twice the middle of a window: one more if a cut window grows by a word, two more if a whole one moves by one.
    middle = F.col("start") * 2 + F.col("n_words")
    in_order = Window.partitionBy("row_key", "item_key").orderBy("middle")
    gaps = held.withColumn("middle", middle).withColumn("gap", F.coalesce(F.col("middle") - F.lag("middle").over(in_order) > 2, F.lit(False)).cast("int"))
    best = gaps.withColumn("place", F.sum("gap").over(in_order)).groupBy("id", "row_key", "item_key", "item_id", "place").agg(
        F.max(F.struct("similarity", (-F.col("middle")).alias("first"), "start", "n_words")).alias("w"))
    return best.select("id", "row_key", "item_id", "w.start", "w.n_words", "w.similarity")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no item, whole."""
    found = leaks(docs, items, id_col, text_col, **options).select("row_key").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key(id_col, text_col).alias("row_key"))
    return rows.join(found, "row_key", "left_anti").select("row.*")


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document: its items, its best similarity, and whether it stays."""
    docs = table(spark, sf_dir, "documents")
    # By row, as ids can be null or stand for several texts.
    found = leaks(docs, table(spark, sf_dir, "benchmark")).groupBy("row_key").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("similarity").alias("similarity"))
    every = docs.select("doc_id", row_key("doc_id", "text").alias("row_key")).join(found, "row_key", "left")
    return every.select(
        "doc_id", F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"),
        F.round(F.coalesce("similarity", F.lit(0.0)), 6).alias("similarity"), F.col("item_ids").isNull().alias("kept"))
