"""Sharding by balanced label propagation.

Linked documents move, round by round, to the shard that most of their neighbours are in, as far as
that shard has room. A last step makes the counts exact: rows above a shard's quota, unlinked ones
first, fill the shards below theirs. Everything is joins and sums over small node rows; the driver
holds one number per shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perfweave.llm.common import bucket_count, stage, table

SHARDS = 24
ROUNDS = 6
# Room above the even size that a shard may fill during the rounds.
SLACK = 0.1


def node_key(id_col: Column, text_col: Column) -> Column:
    """Node of a row: rows that repeat id and text are one node."""
    return F.xxhash64(id_col, text_col)


def copy_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links ``src, dst`` of rows with equal text (null like empty): each to the group's first node."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    nodes = docs.select(node_key(F.col(id_col), F.col(text_col)).alias("src"), F.sha2(text, 256).alias("same"))
    hubs = nodes.groupBy("same").agg(F.min("src").alias("dst"), F.max("src").alias("last")).filter("dst < last")
    return nodes.join(hubs, "same").filter("src != dst").select("src", "dst").distinct()


def _start(node: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(node, F.lit("start")), F.lit(shards)).cast("int")


def _sizes(labels: DataFrame, shards: int) -> list[int]:
    """Rows per shard: one number each, whatever the table."""
    got = {r["shard"]: r["n"] for r in labels.groupBy("shard").agg(F.sum("weight").alias("n")).collect()}
    return [int(got.get(s, 0) or 0) for s in range(shards)]


def propagate(nodes: DataFrame, links: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, slack: float = SLACK) -> DataFrame:
    """Labels ``node, shard, weight`` of all linked nodes after ``rounds`` rounds of moves.

    In a round half the nodes, drawn anew, may move, to the shard with most of its neighbours (the smaller
    number among equals) if that has more of them than its own. A shard takes in as many as it has
    room for: where more ask, a hash of the node decides.
    """
    both = links.select("src", "dst").unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = stage(both.filter("src != dst"))
    linked = both.select(F.col("src").alias("node")).distinct()
    fixed = nodes.withColumn("shard", _start(F.col("node"), shards))
    labels = stage(fixed.join(linked, "node", "left_semi"))
    alone = [a - b for a, b in zip(_sizes(fixed, shards), _sizes(labels, shards), strict=True)]
    for step in range(rounds):
        sizes = [a + b for a, b in zip(alone, _sizes(labels, shards), strict=True)]
        room = [max(0.0, sum(sizes) / shards * (1 + slack) - n) for n in sizes]
        votes = both.join(labels.select(F.col("node").alias("dst"), "shard"), "dst").groupBy("src", "shard").agg(F.count(F.lit(1)).alias("n"))
        own = labels.select(F.col("node").alias("src"), F.col("shard").alias("own"))
        best = votes.join(own, "src").groupBy("src").agg(
            F.max(F.struct("n", (-F.col("shard")).alias("neg"))).alias("top"),
            F.max(F.when(F.col("shard") == F.col("own"), F.col("n"))).alias("own_n"),
        ).select(F.col("src").alias("node"), F.col("top.n").alias("n"), (-F.col("top.neg")).alias("to"), F.coalesce("own_n", F.lit(0)).alias("own_n"))
        turn = F.pmod(F.xxhash64("node", F.lit(f"turn {step}")), F.lit(2)) == 0
        asks = stage(labels.join(best.filter(turn & (F.col("n") > F.col("own_n"))).select("node", "to"), "node", "left"))
        wanted = {r["to"]: r["n"] for r in asks.filter("to IS NOT NULL").groupBy("to").agg(F.sum("weight").alias("n")).collect()}
        if not wanted:
            continue
        share = F.array(*[F.lit(min(1.0, room[s] / max(1, wanted.get(s, 0)))) for s in range(shards)])
        draw = F.pmod(F.xxhash64("node", F.lit(f"draw {step}")), F.lit(1 << 20)) / (1 << 20)
        goes = F.col("to").isNotNull() & (draw < share[F.coalesce("to", F.lit(0))])
        labels = asks.select("node", "weight", F.when(goes, F.col("to")).otherwise(F.col("shard")).alias("shard"))
    return labels


def shard(docs: DataFrame, links: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS,
          rounds: int = ROUNDS, slack: float = SLACK) -> DataFrame:
    """Shard and slot of every row of ``docs``: ``id, size, text_crc32, shard, slot``.

    Counts of shards are at most one apart; slots of a shard run from 0 without a gap. ``links`` has
    ``src, dst`` of ``node_key``. A null text has size 8 and the checksum of the empty one; null ids are
    ids. Rows that repeat id and text share a label, but each takes a slot. No rows give no rows.
    """
    rows = stage(docs.select(
        node_key(F.col(id_col), F.col(text_col)).alias("node"), F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
    ))
    nodes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("weight"))
    labels = propagate(nodes, links, shards, rounds, slack)
    labelled = rows.join(labels.select("node", F.col("shard").alias("label")), "node", "left").select(
        "id", "size", "text_crc32", "node", F.coalesce("label", _start(F.col("node"), shards)).alias("shard"),
        F.col("label").isNull().alias("free"))
    # Places within a shard, linked rows first: running sums over buckets, then inside each.
    n = rows.count()
    buckets = bucket_count(n)
    spread = F.pmod(F.xxhash64("node", F.lit("place")), F.lit(buckets))
    labelled = stage(labelled.withColumn("bucket", spread + F.when(F.col("free"), buckets).otherwise(0)))
    filled = labelled.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(filled.select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"), F.col("n").alias("weight")))
    sizes = _sizes(starts, shards)
    by_size = sorted(range(shards), key=lambda s: (-sizes[s], s))
    quota = [n // shards] * shards
    for s in by_size[: n % shards]:
        quota[s] += 1
    over, room, over_before, room_before = 0, 0, [], []
    for s in range(shards):
        over_before.append(over)
        room_before.append(room)
        over += max(0, sizes[s] - quota[s])
        room += max(0, quota[s] - sizes[s])
    at = lambda values, s: F.get(F.array(*[F.lit(v).cast("long") for v in values]), s)
    inside = Window.partitionBy("shard", "bucket").orderBy("node", "id")
    place = labelled.join(starts.select("shard", "bucket", "start"), ["shard", "bucket"]).withColumn(
        "place", F.col("start") + F.row_number().over(inside) - 1)
    moved = at(over_before, F.col("shard")) + F.col("place") - at(quota, F.col("shard"))
    place = place.withColumn("moved", F.when(F.col("place") >= at(quota, F.col("shard")), moved))
    # The last shard whose room starts at or before the row's number among the moved ones, and has room.
    holes = F.array(*[F.struct(F.lit(room_before[s]).cast("long").alias("first"), F.lit(s).alias("shard"))
                      for s in range(shards) if quota[s] > sizes[s]]) if room else None
    if holes is None:
        out = place.select("id", "size", "text_crc32", "shard", F.col("place").alias("slot"))
    else:
        hole = F.element_at(F.filter(holes, lambda h: h["first"] <= F.col("moved")), -1)
        out = place.withColumn("hole", F.when(F.col("moved").isNotNull(), hole)).select(
            "id", "size", "text_crc32", F.coalesce("hole.shard", "shard").alias("shard"),
            F.coalesce(at(sizes, F.col("hole.shard")) + F.col("moved") - F.col("hole.first"), "place").alias("slot"))
    return out.withColumn("slot", F.col("slot").cast("long"))


def shard_documents(docs: DataFrame) -> DataFrame:
    return shard(docs, copy_links(docs)).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
