"""Near duplicates by circulant MinHash.

Two permutations make a whole signature: the first scatters the shingles over a circle of 2^32 places,
and coordinate k is the smallest value of the second one, shifted by k along the circle. Bands of a
signature bring candidates together; the exact Jaccard similarity of their full sets decides.

Texts with one set of shingles are one class. A bucket never emits all its pairs: classes are compared
with the bucket's leader, then those that can still link with further leaders, until each bucket lies in
one component or all its classes have been compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfweave.llm.common import SHINGLE_WORDS, stage, table

# A pair at similarity 0.75 shares none of the 32 bands with probability 0.000005.
BANDS, BAND_ROWS = 32, 4
# Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
# A text's signature is computed over so many shingles at a time.
_CHUNK = 8192
# Leaders of a bucket in one round after the first; fewer where their sets could exceed LEADER_SHINGLES.
LEADERS = 512
LEADER_SHINGLES = 1_000_000
# Rows of a bucket that one task compares with the leaders, and shingle meetings counted at a time.
BLOCK_ROWS = 2000
_MEETINGS = 8_000_000

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], dtype=np.uint64)


def _mix64(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64(seed)) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(29))


def _permute(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the 32-bit numbers: odd factors and shifts can be undone."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(a)
    x ^= x >> np.uint32(15)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's five-word runs; of all its words if it has fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(len(h), SHINGLE_WORDS)
    total = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        total += h[k : len(h) - n + 1 + k] * _MULTIPLIERS[k]
    return np.unique(_mix64(total, 0))


def set_digest(shingles: np.ndarray) -> bytes:
    """128 bits that equal sets share: two sums over differently mixed elements."""
    return b"".join(int(_mix64(shingles, seed).sum(dtype=np.uint64)).to_bytes(8, "big") for seed in (0x51ED270B, 0x7FB5D329))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The circulant MinHash signature of a set that is not empty."""
    shifts = np.arange(BANDS * BAND_ROWS, dtype=np.uint32)[:, None]
    out = np.full(len(shifts), 0xFFFFFFFF, dtype=np.uint32)
    places = _permute((shingles >> np.uint64(32)).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    for at in range(0, len(places), _CHUNK):
        out = np.minimum(out, _permute(places[None, at : at + _CHUNK] + shifts, 0x85EBCA6B, 0xC2B2AE35).min(1))
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, BAND_ROWS).astype(np.uint64)
    total = np.arange(BANDS, dtype=np.uint64)
    for k in range(BAND_ROWS):
        total = _mix64(total + rows[:, k] * _MULTIPLIERS[k], 0x2545F491)
    return total.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared > 0 and 100 * shared >= percent * (len(a) + len(b) - shared)


def _describe(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        out: dict[str, list] = {"n": [], "cls": [], "bands": []}
        for text in texts:
            s = shingle_set(text)
            out["n"].append(len(s))
            out["cls"].append(set_digest(s) if len(s) else None)
            out["bands"].append(band_keys(signature(s)) if len(s) else None)
        yield pd.DataFrame(out)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_key"))


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` of classes whose full sets are similar enough."""
    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            last, known = None, None
            good = []
            for a, left, right in zip(batch["a"], batch["left"], batch["right"], strict=True):
                if a != last:
                    last, known = a, shingle_set(left)
                good.append(similar(known, shingle_set(right), percent))
            yield batch.loc[good, ["a", "b"]]

    left = pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("left")), "a")
    both = left.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("right")), "b")
    return both.select("a", "b", "left", "right").mapInPandas(check, "a binary, b binary")


class _Leaders:
    """Sets of a bucket's leaders, by shingle."""

    def __init__(self, sets: list[np.ndarray], comps: list[bytes]):
        self.comps, self.sizes = comps, np.array([len(s) for s in sets])
        shingles = np.concatenate(sets)
        by = np.argsort(shingles, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)[by]
        self.keys, self.first, self.times = np.unique(shingles[by], return_index=True, return_counts=True)

    def links(self, sets: list[np.ndarray], comps: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray]:
        """``row, leader`` of similar sets, one pair for any two components."""
        sizes, shingles = np.array([len(s) for s in sets]), np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), sizes)
        at = np.minimum(np.searchsorted(self.keys, shingles), len(self.keys) - 1)
        met = self.keys[at] == shingles
        at, row = at[met], row[met]
        times = self.times[at]
        each = np.repeat(self.first[at] - np.cumsum(times) + times, times) + np.arange(times.sum())
        width = len(self.sizes)
        shared = np.bincount(np.repeat(row, times) * width + self.owner[each], minlength=len(sets) * width).reshape(len(sets), width)
        number: dict[bytes, int] = {}
        mine, theirs = (np.array([number.setdefault(c, len(number)) for c in cs]) for cs in (comps, self.comps))
        good = (shared > 0) & (100 * shared >= percent * (sizes[:, None] + self.sizes - shared)) & (mine[:, None] != theirs)
        row, leader = np.nonzero(good)
        _, one = np.unique(mine[row] * len(number) + theirs[leader], return_index=True)
        return row[one], leader[one]


def _compared(percent: int):
    """Blocks come in, a bucket's leaders (role 0) before its rows; links of different components go out."""
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, index, leaders, rows, size = None, None, [], [], 0

        def settle() -> pd.DataFrame:
            row, leader = index.links([r[2] for r in rows], [r[1] for r in rows], percent)
            return pd.DataFrame({"a": [rows[i][0] for i in row], "b": [leaders[i][0] for i in leader]})

        for batch in batches:
            columns = (batch[c] for c in ("band", "part", "role", "cls", "comp", "text"))
            for band, part, role, cls, comp, text in zip(*columns, strict=True):
                if rows and (block != (band, part) or size * len(leaders) >= _MEETINGS or len(rows) * len(leaders) >= _MEETINGS):
                    yield settle()
                    rows, size = [], 0
                if block != (band, part):
                    block, index, leaders = (band, part), None, []
                shingles = shingle_set(text)
                if role == 0:
                    leaders.append((cls, comp, shingles))
                    continue
                index = index or _Leaders([x[2] for x in leaders], [x[1] for x in leaders])
                rows.append((cls, comp, shingles))
                size += len(shingles)
        if rows:
            yield settle()

    return compare


def _block_links(rows: DataFrame, leaders: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` between the rows of each bucket and its leaders.

    A bucket is cut into parts of some ``BLOCK_ROWS`` rows, and its leaders go to every part; a text moves
    once for its bucket, not once for a pair.
    """
    parts = F.ceil(F.col("m") / BLOCK_ROWS).cast("int")
    ours = rows.select("band", F.pmod(F.xxhash64("cls", F.lit("part")), parts).cast("int").alias("part"), F.lit(1).alias("role"), "cls", "comp")
    theirs = leaders.select("band", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("role"), "lead.cls", "lead.comp")
    blocks = ours.unionByName(theirs).join(texts.select("cls", "text"), "cls")
    return blocks.repartition("band", "part").sortWithinPartitions("band", "part", "role").mapInPandas(_compared(percent), "a binary, b binary")


def components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``cls, comp`` after merging along ``links`` (``a, b``): each component takes its smallest label.

    Components hang themselves under their smallest neighbour, and jumps along those pointers find
    the roots; both are joins over the labels, repeated until no link joins two components.
    """
    while True:
        at = lambda name, to: labels.select(F.col("cls").alias(name), F.col("comp").alias(to))
        across = stage(links.join(at("a", "x"), "a").join(at("b", "y"), "b").filter("x != y").select(
            F.greatest("x", "y").alias("child"), F.least("x", "y").alias("parent")).distinct())
        if across.isEmpty():
            return labels
        parents = stage(across.groupBy("child").agg(F.min("parent").alias("parent")))
        while True:
            up = parents.select(F.col("child").alias("parent"), F.col("parent").alias("above"))
            jumped = stage(parents.join(up, "parent", "left").select("child", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")))
            parents = jumped.select("child", "parent")
            if jumped.filter("moved").isEmpty():
                break
        labels = stage(labels.join(parents.withColumnRenamed("child", "comp"), "comp", "left").select("cls", F.coalesce("parent", "comp").alias("comp")))


def _shared_sizes(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """``cls, n, shared`` of the classes in ``rows``: the size of the set, and how many of its shingles any other of them has."""
    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                sets = [shingle_set(text) for text in batch["text"][at : at + 500]]
                owners = np.repeat(batch["c"].to_numpy()[at : at + 500], [len(s) for s in sets])
                yield pd.DataFrame({"shingle": np.concatenate(sets).view(np.int64), "c": owners})

    there = texts.join(rows.select("cls").distinct(), "cls", "left_semi").withColumn("c", F.xxhash64("cls"))
    once = there.select("c", "text").mapInPandas(explode, "shingle long, c long").groupBy("shingle").agg(
        F.count(F.lit(1)).alias("times"), F.min("c").alias("c")).filter("times = 1")
    own = once.groupBy("c").agg(F.count(F.lit(1)).alias("own"))
    return stage(there.select("cls", "c", "n").join(own, "c", "left").select("cls", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("shared")))


def _linked_classes(buckets: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """``cls, comp`` of all classes in ``buckets`` (``band, cls``).

    First all are compared with one leader of their bucket. What is then left in buckets of several
    components is bounded exactly: two sets that link share at least percent / (100 + percent) of their
    sizes' sum, and no more than either shares with anyone. Classes that cannot reach that in a bucket
    leave it. The rest is compared with further leaders, those with the fewest shingles of their own.
    """
    labels = stage(buckets.select("cls").distinct().withColumn("comp", F.col("cls")))
    leaders_each, bounded = 1, False
    reaches = lambda shared, n, m: (100 + percent) * shared >= percent * (n + m)
    buckets = buckets.withColumn("n", F.lit(1)).withColumn("shared", F.lit(1))

    def mixed(rows: DataFrame) -> DataFrame:
        """Rows of buckets of several components, with the bucket's rows (``m``) and largest set (``most``)."""
        rows = rows.select("band", "cls", "comp", "n", "shared")
        of_band = rows.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("m"), F.max("n").alias("most"))
        return stage(rows.join(of_band.filter("low != high").select("band", "m", "most"), "band"))

    while True:
        rows = mixed(buckets.join(labels, "cls"))
        if leaders_each > 1 and not bounded and not rows.isEmpty():
            rows = rows.select("band", "cls", "comp").join(_shared_sizes(rows, texts), "cls")
            least = rows.groupBy("band").agg(F.min("n").alias("least"))
            rows, bounded = mixed(rows.join(least, "band").filter(reaches(F.col("shared"), F.col("n"), F.col("least")))), True
        if rows.isEmpty():
            return labels
        slots = F.greatest(F.lit(1), F.least(F.lit(leaders_each), F.floor(F.lit(LEADER_SHINGLES) / F.col("most"))))
        slot = F.pmod(F.xxhash64("cls", F.lit(leaders_each)), slots)
        leaders = stage(rows.groupBy("band", "m", slot.alias("slot")).agg(
            F.min(F.struct((F.col("n") - F.col("shared")).alias("own"), "cls", "comp")).alias("lead")).select("band", "m", "lead"))
        if leaders_each == 1:
            pairs = rows.join(leaders.select("band", "lead"), "band").filter(F.col("comp") != F.col("lead.comp")).select(
                F.least("lead.cls", "cls").alias("a"), F.greatest("lead.cls", "cls").alias("b")).distinct()
            links = stage(_verified(pairs, texts, percent))
        else:
            links = stage(_block_links(rows, leaders, texts, percent))
        # A leader has met all others of its bucket.
        met = leaders.select("band", F.col("lead.cls").alias("cls"))
        buckets = stage(rows.select("band", "cls", "n", "shared").join(met, ["band", "cls"], "left_anti"))
        labels = components(labels, links)
        leaders_each = LEADERS


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``id, row_key, n_shingles, component_id, kept`` of every row of ``docs``.

    A component is what links of similarity ``percent`` or more reach; its id is its smallest document
    id. Null, empty and blank texts have no shingles and are linked with nothing. A text of fewer than
    five words has one shingle, all its words. Null ids come after all others. Rows that repeat an id
    and text have equal results.
    """
    rows = _keyed(docs, id_col, text_col)
    describe = F.pandas_udf(_describe, "n int, cls binary, bands array<long>")
    described = stage(rows.select("id", "row_key", describe("text").alias("d")).select("id", "row_key", "d.*"))
    classes = stage(described.filter("n > 0").groupBy("cls").agg(
        F.min("id").alias("id"), F.min("row_key").alias("row_key"), F.max("n").alias("n"), F.max("bands").alias("bands")))
    banded = classes.select("cls", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("band")
    buckets = stage(banded.join(shared, "band", "left_semi"))
    members = buckets.select("cls").distinct().join(classes.select("cls", "row_key", "n"), "cls")
    texts = stage(rows.join(members, "row_key").select("cls", "n", "text").dropDuplicates(["cls"]))
    linked = _linked_classes(buckets, texts, percent)
    named = classes.select("cls", "id").join(linked, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    smallest = named.groupBy("comp").agg(F.min("id").alias("component_id"))
    of_class = stage(named.join(smallest, "comp").select("cls", "component_id", "comp"))
    out = described.select("id", "row_key", F.col("n").alias("n_shingles"), "cls").join(of_class, "cls", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select("id", "row_key", F.col("n_shingles").cast("long"), component.alias("component_id"),
                      F.col("id").eqNullSafe(component).alias("kept"), "comp")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component, one with its smallest id, and all rows without shingles."""
    groups = near_groups(docs, id_col, text_col, percent)
    grouped = groups.filter("kept AND n_shingles > 0").groupBy("comp").agg(F.min("row_key").alias("row_key"))
    keep = stage(grouped.select("row_key").unionByName(groups.filter("n_shingles = 0").select("row_key")).distinct())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_key"))
    kept = rows.join(keep, "row_key", "left_semi")
    return kept.dropDuplicates(["row_key"]).select("row.*")


def op6_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")
