"""Repeated word sequences by recompression.

Each text is rewritten in rounds: runs of one symbol get a name, then neighbouring symbols of two
classes are paired and get a name. Names and classes are hashes of what they stand for, so they are the
same in every text without a shuffle, and equal word sequences end in equal symbols except near their
ends. How far a symbol's boundary depends on its surroundings is tracked exactly: within a window, the
highest boundary that depends on words of the window alone is its anchor, and equal windows have equal
anchors. Anchors that occur once reveal that none of their windows repeats; of the others, windows with
equal surroundings are equal at once, and the rest are compared by a 128-bit hash of all their words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfweave.llm.common import stage, table
from perfweave.llm.repeats import COMPARE, EQUAL, SENT, repeated, settle

WINDOW_WORDS = 35
ROUNDS = 6
# An anchor must depend on so many words at least, so that it tells texts apart.
LEAST_CONTEXT = 7
# Words that are rewritten together; longer texts are cut into pieces that overlap by a window.
PIECE_WORDS = 1 << 18

_FAR = 1 << 40
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ODD2 = np.uint64(0xD1B54A32D192ED03)
_ODD2_INVERSE = np.uint64(pow(0xD1B54A32D192ED03, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RangeHash:
    """Hashes of ranges of a sequence from running sums."""

    def __init__(self, symbols: np.ndarray, odd: np.uint64 = _ODD, inverse: np.uint64 = _ODD_INVERSE) -> None:
        n = len(symbols)
        powers = np.full(n + 1, odd, dtype=np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(symbols * powers[:n], out=self.sums[1:])
        self.undo = np.full(n + 1, inverse, dtype=np.uint64)
        self.undo[0] = 1
        self.undo = np.multiply.accumulate(self.undo)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.undo[start] + (end - start).astype(np.uint64))


def anchors(h: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows of a sequence of hashed words.

    ``first`` holds the positions where texts begin. Returns arrays ``key, wide, start, count``: an anchor
    stands for ``count`` windows from ``start`` on; ``key`` is shared by all places that may have an equal
    window, ``wide`` by those where all its windows are equal.
    """
    n = len(h)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    # Boundaries: position, and the range [low, high) of words that they depend on. Symbols: name and range.
    at = np.arange(n, dtype=np.int64)
    low, high = at.copy(), at.copy()
    low[first] -= _FAR
    name, s_low, s_high = h.copy(), at.copy(), at + 1
    edge = np.zeros(n, dtype=bool)
    edge[first] = True
    levels = []

    def close(keep: np.ndarray, dep_low: np.ndarray, dep_high: np.ndarray, renamed: np.ndarray) -> None:
        """Drops the boundaries that do not stay; symbols between take over what their parts depend on."""
        nonlocal at, low, high, name, s_low, s_high, edge
        places = np.flatnonzero(keep)
        s_low, s_high = np.minimum.reduceat(s_low, places), np.maximum.reduceat(s_high, places)
        at, edge, name = at[places], edge[places], renamed
        low, high = dep_low[places], dep_high[places]
        after_low, after_high = np.append(low[1:], n), np.append(high[1:], n + _FAR)
        ends_text = np.append(edge[1:], True)
        s_low = np.minimum(s_low, np.minimum(low, after_low))
        s_high = np.maximum(s_high, np.maximum(high, after_high))
        s_high[ends_text] = n + _FAR  # the end of a text is nothing that a window can see
        levels.append((at, low, high, edge))

    for step in range(ROUNDS):
        before = np.concatenate(([0], np.arange(len(at) - 1)))
        if step == 0:
            # A run of one symbol: reads both symbols.
            keep = edge | (name != name[before])
            dep_low, dep_high = np.minimum(low, s_low[before]), np.maximum(high, s_high)
            places = np.flatnonzero(keep)
            length = np.diff(np.append(places, len(name))).astype(np.uint64)
            renamed = np.where(length > 1, mix(name[places] + length * _ODD2), name[places])
        else:
            # Pairs of a left and a right symbol: reads the right one, and the left one only if it must.
            right = (mix(name + np.uint64(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) & np.uint64(1)).astype(bool)
            keep = edge | ~right | right[before]
            dep_low = np.where(right, np.minimum(low, np.minimum(s_low, s_low[before])), np.minimum(low, s_low))
            dep_high = np.where(right, np.maximum(high, np.maximum(s_high, s_high[before])), np.maximum(high, s_high))
            places = np.flatnonzero(keep)
            # No two boundaries in a row are dropped, so a symbol has one part or two.
            two = np.diff(np.append(places, len(name))) == 2
            second = np.minimum(places + 1, len(name) - 1)
            renamed = np.where(two, mix(name[places] * _ODD + name[second] + np.uint64(step)), name[places])
        dep_low = np.where(edge, low, dep_low)
        dep_high = np.where(edge, high, dep_high)
        close(keep, dep_low, dep_high, renamed)

    ends = np.append(first[1:], n)
    text_of = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
    begin, end = first[text_of], ends[text_of]
    valid = np.arange(n) + window <= end
    taken = ~valid
    ranges = RangeHash(h)
    keys, wides, starts, counts = [], [], [], []
    for level in range(len(levels) - 1, 0, -1):
        b_at, b_low, b_high, b_edge = levels[level]
        ok = ~b_edge & (b_high - b_low <= window) & (b_high - b_low >= LEAST_CONTEXT)
        b_at, b_low, b_high = b_at[ok], b_low[ok], b_high[ok]
        s = np.maximum(b_high - window, begin[b_at])
        e = np.minimum(b_low + window, end[b_at])
        fits = e - s >= window
        b_at, b_low, b_high, s, e = b_at[fits], b_low[fits], b_high[fits], s[fits], e[fits]
        if not len(b_at):
            continue
        place = ((b_at - b_low) * 64 + level).astype(np.uint64)
        key = mix(ranges.of(b_low, b_high) + place * _ODD2)
        # Each window takes the anchor of the smallest key, which is written last: few serve many windows.
        order = np.argsort(key)[::-1]
        count = (e - s - window + 1)[order]
        owner = np.repeat(order, count)
        windows = s[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        open_ = ~taken[windows]
        owner, windows = owner[open_], windows[open_]
        chosen = np.full(n, -1, dtype=np.int64)
        chosen[windows] = owner
        taken[windows] = True
        used = np.unique(chosen[chosen >= 0])
        if not len(used):
            continue
        lo, hi, s, e, key = b_low[used], b_high[used], s[used], e[used], key[used]
        keys.append(key)
        wides.append(mix(ranges.of(s, e) ^ key) + ((lo - s) * 65536 + (e - lo)).astype(np.uint64) * _ODD)
        starts.append(s)
        counts.append(e - s - window + 1)
    alone = np.flatnonzero(~taken)  # windows without an anchor, as inside long runs: their own
    keys.append(ranges.of(alone, alone + window))
    wides.append(np.zeros(len(alone), dtype=np.uint64))
    starts.append(alone)
    counts.append(np.ones(len(alone), dtype=np.int64))
    return (np.concatenate(keys).view(np.int64), np.concatenate(wides).view(np.int64), np.concatenate(starts), np.concatenate(counts))


def hashed_words(text: str | None) -> np.ndarray:
    """A hash of each word of the text's UTF-8 bytes; ``bytes.split`` knows ASCII white space only."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def pieces(texts: list[str | None], window: int, most: int = PIECE_WORDS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Sequences of about ``most`` words: hashes, where texts begin, which text, and its words before."""
    parts: list[tuple[np.ndarray, int, int]] = []
    size = 0

    def joined():
        lengths = [len(p) for p, _, _ in parts]
        first = np.cumsum([0, *lengths[:-1]])
        return np.concatenate([p for p, _, _ in parts]), first, np.array([t for _, t, _ in parts]), np.array([o for _, _, o in parts])

    for i, text in enumerate(texts):
        h = hashed_words(text)
        if len(h) < window:
            continue
        for at in range(0, len(h) - window + 1, most - window + 1):
            part = h[at : at + most]
            parts.append((part, i, at))
            size += len(part)
            if size >= most:
                yield joined()
                parts, size = [], 0
    if parts:
        yield joined()


def _places(window: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            owners = batch["row_key"].to_numpy()
            found = []
            for h, first, text, before in pieces(batch["text"].tolist(), window):
                key, wide, start, count = anchors(h, first, window)
                part = np.searchsorted(first, start, "right") - 1
                found.append((key, wide, owners[text[part]], start - first[part] + before[part], count))
            if found:
                yield from settle(*map(np.concatenate, zip(*found, strict=True)), keep_first=False)

    return places


def _compared(window: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The windows that must be compared, each by two hashes of all its words."""
    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for owner, text, spans in zip(batch["row_key"], batch["text"], batch["spans"], strict=True):
                h = hashed_words(text)
                at = np.unique(np.concatenate([np.arange(s["start"], s["start"] + s["count"]) for s in spans]))
                one, two = RangeHash(h).of(at, at + window), RangeHash(h, _ODD2, _ODD2_INVERSE).of(at, at + window)
                found.append((one.view(np.int64), two.view(np.int64), np.full(len(at), owner), at, np.ones(len(at), dtype=np.int64)))
            if found:
                yield from settle(*map(np.concatenate, zip(*found, strict=True)), keep_first=False)

    return compared


def _removed(window: int) -> Callable[[Iterator[tuple[pd.Series, pd.Series]]], Iterator[pd.DataFrame]]:
    def removed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, all_spans in batches:
            out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_text": []}
            for text, spans in zip(texts, all_spans, strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                if spans is not None:
                    change = np.zeros(len(words) + 1, dtype=np.int64)
                    for s in spans:
                        change[s["start"]] += 1
                        change[s["start"] + s["count"] - 1 + window] -= 1
                    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()
                else:
                    kept = range(len(words))
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - len(kept))
                out["kept_text"].append(b" ".join([words[i] for i in kept]).decode("utf-8", "surrogatepass"))
            yield pd.DataFrame(out)

    removed.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    return removed


def repeated_spans(rows: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """``owner, spans`` (arrays of ``start, count``): the windows of ``rows`` (``row_key, text``) that start elsewhere too."""
    met = repeated(rows.mapInPandas(_places(window), SENT), stage, keep_first=False)
    compare = met.filter(F.col("kind") == COMPARE).groupBy("owner").agg(F.collect_set(F.struct("start", "count")).alias("spans"))
    windows = rows.join(compare.withColumnRenamed("owner", "row_key"), "row_key").select("row_key", "text", "spans")
    again = repeated(windows.mapInPandas(_compared(window), SENT), stage, keep_first=False)
    spans = met.filter(F.col("kind") == EQUAL).unionByName(again.filter(F.col("kind") == EQUAL))
    return spans.groupBy("owner").agg(F.collect_set(F.struct("start", "count")).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_WORDS) -> DataFrame:
    """``id, n_words, n_removed, kept_text`` of every row of ``docs``.

    Words are runs of anything but the six ASCII white-space characters. A word goes if a window of
    ``window`` words that covers it starts anywhere else too, in the same row or another; all are judged on
    the input. Null, empty and short texts lose nothing. Rows that repeat id and text are two places: their
    words go if there are enough for a window.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_key"), F.col(text_col).alias("text"))
    spans = repeated_spans(rows.select("row_key", "text"), window)
    joined = rows.join(spans.withColumnRenamed("owner", "row_key"), "row_key", "left")
    removed = F.pandas_udf(_removed(window), "n_words long, n_removed long, kept_text string")
    return joined.select("id", removed("text", "spans").alias("r")).select("id", "r.*")


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
