"""Repeated byte strings by interval expansion on a Burrows-Wheeler transform.

Every window of a text is represented by a sampled place in it (the smallest hash of 32 bytes), so that
equal windows are represented by equal places. Places that occur once hold no repeat and places with
equal surroundings are equal copies. Where one place has different surroundings, all of them are put
side by side in one task: their suffixes are sorted, and backward extension on the transform, breadth
first, gives the common prefixes of neighbouring suffixes by increasing length. It stops at the window's
length: neighbours without a value by then share a whole window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfweave.llm.common import stage, table
from perfweave.llm.repeats import COMPARE, EQUAL, SENT, repeated, settle
from perfweave.llm.substrings import _ODD2, _ODD2_INVERSE, RangeHash, mix

WINDOW_BYTES = 100
SAMPLE_BYTES = 32
PIECE_BYTES = 1 << 21
# Bytes of surroundings that one transform holds (whole places only).
TRANSFORM_BYTES = 1 << 18
# A place with more different surroundings has its windows compared by 128-bit hashes, spread over tasks.
MOST_SURROUNDINGS = 2000

_SYMBOLS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def as_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def places_of(data: np.ndarray, end: np.ndarray, window: int, sample: int = SAMPLE_BYTES):
    """``key, wide, start, count`` of the sampled places of a sequence of bytes.

    ``end`` holds for each position where its text ends; windows never reach beyond it.
    """
    n = len(data)
    starts = n - window + 1
    none = np.zeros(0, dtype=np.int64)
    if starts <= 0:
        return none, none, none, none
    ranges = RangeHash(_SYMBOLS[data])
    at = np.arange(n - sample + 1)
    value = ranges.of(at, at + sample)
    # Hash and position in one number: the smallest is the leftmost of the smallest hash.
    low_bits = np.uint64(max(1, n.bit_length()))
    least = (value >> low_bits << low_bits) | at.astype(np.uint64)
    reach, most = 1, window - sample + 1
    while reach * 2 <= most:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if most > reach:
        least = np.minimum(least[: len(least) - (most - reach)], least[most - reach :])
    chosen = (least & ((np.uint64(1) << low_bits) - np.uint64(1))).astype(np.int64)
    valid = np.arange(starts) + window <= end[:starts]
    new = np.ones(starts, dtype=bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | ~valid[:-1]
    start = np.flatnonzero(new & valid)
    if not len(start):
        return none, none, none, none
    breaks = np.append(np.flatnonzero(new | ~valid), starts)
    stop = breaks[np.searchsorted(breaks, start, "right")]
    count = stop - start
    key = value[chosen[start]]
    wide = mix(ranges.of(start, stop - 1 + window) ^ key) + (chosen[start] - start).astype(np.uint64) * _ODD2
    return key.view(np.int64), wide.view(np.int64), start, count


def suffix_order(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes by their first ``depth`` symbols or more, and each suffix's place in it."""
    n = len(symbols)
    # The first four symbols at once: a quarter of a number each.
    base = int(symbols.max(initial=0)) + 2
    rank, length = symbols.astype(np.int64) + 1, 1
    while length < 4 and base ** (length + 1) < 1 << 62:
        rank = rank * base
        rank[: n - length] += symbols[length:] + 1
        length += 1
    order = np.argsort(rank)
    while True:
        new = np.ones(n, dtype=bool)
        new[1:] = rank[order[1:]] != rank[order[:-1]]
        dense = np.empty(n, dtype=np.int64)
        dense[order] = np.cumsum(new)
        if length >= depth or new.all():
            break
        key = dense * (n + 1)
        key[: n - length] += dense[length:]
        rank, length = key, length * 2
        order = np.argsort(rank)
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    return order, place


def repeat_classes(segments: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``segment, offset, class`` of all windows of the segments that occur more than once."""
    lengths = np.array([len(s) for s in segments], dtype=np.int64)
    first = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
    n = int(lengths.sum()) + len(segments)
    ends = first + lengths
    # Each segment ends in a symbol of its own, smaller than all bytes.
    symbols = np.empty(n, dtype=np.int64)
    inner = np.ones(n, dtype=bool)
    inner[ends] = False
    symbols[inner] = np.frombuffer(b"".join(segments), dtype=np.uint8).astype(np.int64) + len(segments)
    symbols[ends] = np.arange(len(segments))
    order, place = suffix_order(symbols, window)
    # The transform: the symbol before each suffix, and where that longer suffix stands. The end symbols'
    # own predecessors are bytes; what precedes a segment's first byte is never extended to.
    before = order - 1
    extends = (before >= 0) & (symbols[before] >= len(segments))
    longer = np.where(extends, place[before], -1)
    known = np.zeros(n + 1, dtype=bool)  # boundary i lies between the suffixes i-1 and i
    known[0] = known[n] = True
    sorted_symbols = symbols[order]
    new = np.append(True, sorted_symbols[1:] != sorted_symbols[:-1])
    known[np.append(np.flatnonzero(new)[1:], n)] = True
    # The suffixes of all live intervals, and which interval each is in.
    at, interval = np.arange(n), np.cumsum(new)
    slots, taken = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    for _ in range(1, window):
        to = longer[at]
        interval, to = interval[to >= 0], to[to >= 0]
        # One extension for each symbol before: its suffixes stand side by side, apart from those of all others,
        # so their places alone put them in order.
        if len(to) < n // 64:
            by = np.argsort(to)
            interval, to = interval[by], to[by]
        else:
            slots[to], taken[to] = interval, True
            to = np.flatnonzero(taken)
            interval, taken[to] = slots[to], False
        if not len(to):
            break
        before = sorted_symbols[to]
        new = np.append(True, (interval[1:] != interval[:-1]) | (before[1:] != before[:-1]))
        right = to[np.append(np.flatnonzero(new)[1:], len(to)) - 1] + 1
        fresh = ~known[right]
        known[right] = True
        extension = np.cumsum(new)
        live = fresh[extension - 1]
        at, interval = to[live], extension[live]
    label = np.cumsum(known[:n])
    size = np.bincount(label)
    twice = size[label] > 1
    found, label = order[twice], label[twice]
    segment = np.searchsorted(first, found, "right") - 1
    return segment, found - first[segment], label


def _pieces(texts: list[str | None], window: int, most: int = PIECE_BYTES):
    parts: list[tuple[bytes, int, int]] = []
    size = 0
    for i, text in enumerate(texts):
        data = as_bytes(text)
        for at in range(0, len(data) - window + 1, most - window + 1):
            parts.append((data[at : at + most], i, at))
            size += len(parts[-1][0])
            if size >= most:
                yield parts
                parts, size = [], 0
    if parts:
        yield parts


def _places(window: int):
    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            owners, found = batch["owner"].to_numpy(), []
            for parts in _pieces(batch["text"].tolist(), window):
                lengths = np.array([len(p) for p, _, _ in parts])
                first = np.cumsum(lengths) - lengths
                text, before = np.array([t for _, t, _ in parts]), np.array([b for _, _, b in parts])
                data = np.frombuffer(b"".join(p for p, _, _ in parts), dtype=np.uint8)
                key, wide, start, count = places_of(data, np.repeat(first + lengths, lengths), window)
                part = np.searchsorted(first, start, "right") - 1
                found.append((key, wide, owners[text[part]], start - first[part] + before[part], count))
            if found:
                yield from settle(*map(np.concatenate, zip(*found, strict=True)), keep_first=True)

    return places


def _segments(window: int):
    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                out: list[tuple] = []
                part = batch.iloc[at : at + 500]
                for owner, text, spans in zip(part["owner"], part["text"], part["spans"], strict=True):
                    data = as_bytes(text)
                    out += [(s["key"], owner, s["start"], data[s["start"] : s["start"] + s["count"] - 1 + window]) for s in spans]
                yield pd.DataFrame(out, columns=["key", "owner", "start", "segment"])

    return segments


def _later(owner: np.ndarray, start: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Indices of all but the earliest of each class."""
    by = np.lexsort((start, owner, label))
    return by[1:][label[by[1:]] == label[by[:-1]]]


def _transformed(window: int):
    """Rows sorted by key come in; the windows that an earlier one equals go out."""
    def transformed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size = 0

        def settle_held() -> pd.DataFrame:
            segment, offset, label = repeat_classes([r[3] for r in held], window)
            owner = np.array([r[1] for r in held], dtype=np.int64)[segment]
            start = np.array([r[2] for r in held], dtype=np.int64)[segment] + offset
            later = _later(owner, start, label)
            return pd.DataFrame({"owner": owner[later], "start": start[later].astype(np.int32), "count": np.ones(len(later), dtype=np.int32)})

        for batch in batches:
            for row in batch[["key", "owner", "start", "segment"]].itertuples(index=False, name=None):
                if size >= TRANSFORM_BYTES and row[0] != held[-1][0]:
                    yield settle_held()
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield settle_held()

    return transformed


def _windows(window: int):
    """Windows of places with very many surroundings, by two hashes each."""
    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for owner, start, segment in zip(batch["owner"], batch["start"], batch["segment"], strict=True):
                symbols = _SYMBOLS[np.frombuffer(segment, dtype=np.uint8)]
                at = np.arange(len(segment) - window + 1)
                one, two = RangeHash(symbols).of(at, at + window), RangeHash(symbols, _ODD2, _ODD2_INVERSE).of(at, at + window)
                found.append((one.view(np.int64), two.view(np.int64), np.full(len(at), owner), at + start, np.ones(len(at), dtype=np.int64)))
            if found:
                yield from settle(*map(np.concatenate, zip(*found, strict=True)), keep_first=True)

    return windows


def _removed(window: int):
    def removed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, all_spans in batches:
            out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
            for text, spans in zip(texts, all_spans, strict=True):
                data, gone, runs = as_bytes(text), 0, []
                kept = data
                if spans is not None:
                    change = np.zeros(len(data) + 1, dtype=np.int64)
                    for s in spans:
                        change[s["start"]] += 1
                        change[s["start"] + s["count"] - 1 + window] -= 1
                    covered = np.cumsum(change[:-1]) > 0
                    kept = np.frombuffer(data, dtype=np.uint8)[~covered].tobytes()
                    gone = int(covered.sum())
                    runs = np.flatnonzero(np.diff(np.concatenate(([0], covered.astype(np.int8)))) == 1)
                out["n_bytes"].append(len(data))
                out["n_removed"].append(gone)
                out["n_spans"].append(len(runs))
                out["kept"].append(kept)
            yield pd.DataFrame(out)

    removed.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    return removed


def in_order(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``owner, id, text`` of all rows, where ``owner`` numbers the documents in order; and of each document once.

    It is the id itself where ids are unique and not null. Otherwise null ids come first and rows with
    one id follow by a hash of their text; rows equal in both are one document, with one number.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR id IS NULL").isEmpty():
        rows = rows.select(F.col("id").alias("owner"), "id", "text")
        return rows, rows
    hashed = rows.withColumn("h", F.xxhash64("text"))
    keys = hashed.select("id", "h").distinct().orderBy(F.col("id").asc_nulls_first(), "h")
    numbered = keys.rdd.zipWithIndex().map(lambda r: (r[0]["id"], r[0]["h"], r[1]))
    numbers = stage(docs.sparkSession.createDataFrame(numbered, "other_id long, other_h long, owner long"))
    same = F.col("id").eqNullSafe(F.col("other_id")) & (F.col("h") == F.col("other_h"))
    rows = hashed.join(numbers, same).select("owner", "id", "text")
    return rows, rows.dropDuplicates(["owner"])


def earlier_spans(rows: DataFrame, window: int = WINDOW_BYTES) -> DataFrame:
    """``owner, spans`` (arrays of ``start, count``): windows of ``rows`` (``owner, text``) that also start earlier."""
    met = repeated(rows.mapInPandas(_places(window), SENT), stage, keep_first=True)
    compare = met.filter(F.col("kind") == COMPARE)
    many = compare.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MOST_SURROUNDINGS).select("key")
    spans = compare.groupBy("owner").agg(F.collect_set(F.struct("key", "start", "count")).alias("spans"))
    segments = stage(rows.join(spans, "owner").mapInPandas(_segments(window), "key long, owner long, start int, segment binary"))
    few = segments.join(many, "key", "left_anti").repartition("key").sortWithinPartitions("key")
    later = few.mapInPandas(_transformed(window), "owner long, start int, count int")
    rest = repeated(segments.join(many, "key", "left_semi").mapInPandas(_windows(window), SENT), stage, keep_first=True)
    equal = met.unionByName(rest).filter(F.col("kind") == EQUAL).select("owner", "start", "count")
    return equal.unionByName(later).groupBy("owner").agg(F.collect_set(F.struct("start", "count")).alias("spans"))


def remove_earlier(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_BYTES) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept`` (bytes) of every row of ``docs``.

    A byte goes if a string of ``window`` bytes that covers it also starts earlier: in a document with a
    smaller id, or before in the same one. The input is judged, not what is left. Null and empty texts have
    no bytes, short ones lose none. Of null and repeated ids see ``in_order``.
    """
    rows, once = in_order(docs, id_col, text_col)
    spans = earlier_spans(once.select("owner", "text"), window)
    removed = F.pandas_udf(_removed(window), "n_bytes long, n_removed long, n_spans long, kept binary")
    return rows.join(spans, "owner", "left").select("id", removed("text", "spans").alias("r")).select("id", "r.*")


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    kept = remove_earlier(table(spark, sf_dir, "documents"))
    return kept.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
