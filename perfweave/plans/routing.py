"""Raw facts or rollup?

The two answer the same question differently at the edges of a window (a rollup bucket
counts as a whole), so this is an explicit mode and not a silent rewrite.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfweave.config import check_mode


def use_rollup(rollup: DataFrame | None, source: str, mode: str, known: frozenset[str] | None = None) -> bool:
    """Whether to answer from ``rollup``: in ``auto``, as soon as it has a row of the source.

    ``known`` are the sources it has rows of, where the store's log tells; else one row is looked for.
    """
    if check_mode(mode) != "auto":
        if mode == "rollup" and rollup is None:
            raise ValueError("No rollup available")
        return mode == "rollup"
    if rollup is None:
        return False
    if known is not None:
        return source in known
    return not rollup.filter(F.col("source") == source).limit(1).isEmpty()
