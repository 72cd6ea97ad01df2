"""Surrogate keys computed from natural keys: no sequence, no lookup join."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def description_id(source: Column, description: Column, attempt: int = 0) -> Column:
    """Positive 63-bit id of a (source, description) pair.

    n distinct names collide with probability about n^2 / 2^64 (a million names: 3e-8). A name whose id another
    one has takes that of the next ``attempt`` (``operators.dims.free_ids``).
    """
    named = F.xxhash64(source, description, F.lit(attempt)) if attempt else F.xxhash64(source, description)
    h = named.bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF).cast("bigint"))
    return F.when(h == 0, F.lit(1).cast("bigint")).otherwise(h)


def report_id(source: Column, reported_at: Column, file_key: Column, offset: Column) -> Column:
    """Id of a report block: where it lies, so it does not depend on how the file was split."""
    return F.xxhash64(source, reported_at, file_key, offset)


def file_no(file_key: Column) -> Column:
    """A file's number: rows carry it instead of the name, as it is of fixed width."""
    return F.xxhash64(file_key)
