"""Which places share content: the shuffle behind both substring operators.

A place is ``key, wide, owner, start, count``: ``count`` windows of text ``owner`` from ``start`` on. Places
with equal windows have equal keys; places with equal ``key`` and ``wide`` are equal in all their windows.
Each batch of a task settles the repeats within it and sends one row of a key to the shuffle, so a key
that a third of all texts hold arrives once for each batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SENT = "key long, wide long, owner long, start int, count int, kind int"
# Kinds of rows: sent with one surrounding, sent for several, all windows repeat, windows must be compared.
ONE, SEVERAL, EQUAL, COMPARE = 0, 1, 2, 3


def _group_starts(*sorted_columns: np.ndarray) -> np.ndarray:
    n = len(sorted_columns[0])
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _frame(key, wide, owner, start, count, kind: int) -> pd.DataFrame:
    return pd.DataFrame({"key": key, "wide": wide, "owner": owner, "start": start.astype(np.int32), "count": count.astype(np.int32),
                         "kind": np.full(len(key), kind, dtype=np.int32)})


def settle(key: np.ndarray, wide: np.ndarray, owner: np.ndarray, start: np.ndarray, count: np.ndarray, keep_first: bool) -> Iterator[pd.DataFrame]:
    """What a batch knows by itself, and what it sends. With ``keep_first`` the earliest of equal places,
    by owner and start, does not count as a repeat."""
    order = np.lexsort((start, owner, wide, key))
    key, wide, owner, start, count = key[order], wide[order], owner[order], start[order], count[order]
    if not len(key):
        return
    new_wide = _group_starts(key, wide)
    sizes = np.diff(np.append(np.flatnonzero(new_wide), len(key)))
    equal = np.repeat(sizes > 1, sizes) & ~(new_wide & keep_first)
    yield _frame(key[equal], wide[equal], owner[equal], start[equal], count[equal], EQUAL)
    key, wide, owner, start, count = key[new_wide], wide[new_wide], owner[new_wide], start[new_wide], count[new_wide]
    new_key = _group_starts(key)
    sizes = np.diff(np.append(np.flatnonzero(new_key), len(key)))
    several = np.repeat(sizes > 1, sizes)
    yield _frame(key[several], wide[several], owner[several], start[several], count[several], COMPARE)
    for kind, pick in ((ONE, ~several), (SEVERAL, several & new_key)):
        yield _frame(key[pick], wide[pick], owner[pick], start[pick], count[pick], kind)


def _meet(keep_first: bool):
    """Settles the sent rows of each key, which come sorted by key; a key may run over several batches."""
    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None

        def done(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            rows = rows.sort_values(["key", "wide", "owner", "start"], kind="stable")
            key, wide, kind = rows["key"].to_numpy(), rows["wide"].to_numpy(), rows["kind"].to_numpy()
            new_key = _group_starts(key)
            sizes = np.diff(np.append(np.flatnonzero(new_key), len(key)))
            of = np.repeat(np.arange(len(sizes)), sizes)
            several = np.maximum.reduceat(kind, np.flatnonzero(new_key)) == SEVERAL
            one = kind == ONE
            rows, key, wide, of = rows[one], key[one], wide[one], of[one]
            if not len(key):
                return
            new_wide = _group_starts(key, wide)
            wide_sizes = np.diff(np.append(np.flatnonzero(new_wide), len(key)))
            equal = np.repeat(wide_sizes > 1, wide_sizes) & ~(new_wide & keep_first)
            mixed = (np.bincount(of[new_wide], minlength=len(sizes)) > 1) | several
            yield rows[equal].assign(kind=np.int32(EQUAL))
            yield rows[new_wide & mixed[of]].assign(kind=np.int32(COMPARE))

        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch])
            if not len(rows):
                continue
            last = rows["key"].to_numpy() == rows["key"].iloc[-1]
            rest = rows[last]
            yield from done(rows[~last]) if (~last).any() else ()
        if rest is not None:
            yield from done(rest)

    return meet


def repeated(places: DataFrame, stage, keep_first: bool) -> DataFrame:
    """``key, owner, start, count, kind`` (``EQUAL`` or ``COMPARE``) from the output of ``settle``."""
    places = stage(places)
    sent = places.filter(F.col("kind") <= SEVERAL).repartition("key").sortWithinPartitions("key")
    met = sent.mapInPandas(_meet(keep_first), SENT)
    return stage(places.filter(F.col("kind") > SEVERAL).unionByName(met).select("key", "owner", "start", "count", "kind").distinct())
