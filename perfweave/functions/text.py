"""Byte-exact text handling.

Log bytes need not be valid UTF-8, and a regular expression over a broken string would
replace the bad bytes. Lines are therefore parsed as ISO-8859-1, where one character is
one byte, and encoded back to the original bytes afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters removed around a name or detail.
TRIM_SET = " \n\r\t\u000b\u0000"


def bytes_to_chars(raw: Column) -> Column:
    return F.decode(raw.cast("binary"), "ISO-8859-1")


def chars_to_bytes(chars: Column) -> Column:
    """Back to the original bytes, typed STRING (not validated)."""
    return F.encode(chars, "ISO-8859-1").cast("string")


def trim_text(s: Column) -> Column:
    return F.btrim(s, F.lit(TRIM_SET))


def leading_int(s: Column) -> Column:
    """Integer at the start of a string; 0 where there is none."""
    return F.coalesce(F.regexp_extract(s, r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def leading_float(s: Column) -> Column:
    """Decimal number at the start of a string; 0 where there is none."""
    number = F.regexp_extract(s, r"^([+-]?(?:\d+(?:\.\d*)?|\.\d+))", 1)
    return F.coalesce(number.try_cast("double"), F.lit(0.0))


def clean_text(s: Column) -> Column:
    """Text safe for JSON: invalid byte sequences become U+FFFD. Stored bytes stay as they are."""
    return F.make_valid_utf8(s)
