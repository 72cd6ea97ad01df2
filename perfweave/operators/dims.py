"""The name dimension: (source, description) -> description_id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perfweave.config import check_description_id
from perfweave.functions import keys
from perfweave.functions.text import clean_text


# Attempts at an id of its own for a name; with 63 bits a second one is as good as never needed.
MOST_MOVES = 64


def names_of(rows: DataFrame) -> DataFrame:
    """Distinct names in ``rows`` with their computed ids. Copies combine on the map side."""
    distinct = rows.select("source", "description").distinct()
    return distinct.select(
        keys.description_id(F.col("source"), F.col("description")).alias("description_id"),
        "source",
        "description",
    )


def new_names(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Names in ``rows`` not in the dimension yet."""
    return names_of(rows).join(known.select("source", "description"), ["source", "description"], "left_anti").select(
        "description_id", "source", "description"
    )


def resolve_ids(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Attaches ``description_id`` by lookup, for dimensions whose ids are not computed."""
    ids = known.select("source", "description", "description_id")
    return rows.join(ids, ["source", "description"], "left")


def id_collisions(descriptions: DataFrame) -> DataFrame:
    """Ids shared by different names: empty unless two names hash alike."""
    named = descriptions.select("description_id", "source", "description").distinct()
    return named.groupBy("description_id").agg(F.count(F.lit(1)).alias("names")).filter("names > 1")


def clashing_names(new: DataFrame, known: DataFrame) -> DataFrame:
    """Names in ``new`` whose id another name has, in ``new`` or in ``known``, with that name."""
    other = new.select("description_id", "source", "description").unionByName(known.select("description_id", "source", "description"))
    other = other.withColumnsRenamed({"source": "other_source", "description": "other_description"})
    differ = (F.col("source") != F.col("other_source")) | (F.col("description") != F.col("other_description"))
    return new.join(other, "description_id").filter(differ)


def moved_names(names: DataFrame) -> DataFrame:
    """Names with another id than their own hash, which some other name has."""
    return names.filter(F.col("description_id") != keys.description_id(F.col("source"), F.col("description")))


def with_ids(rows: DataFrame, moved: DataFrame | None = None) -> DataFrame:
    """``rows`` with the ids of their names: the hash, but for names that were ``moved``."""
    own = keys.description_id(F.col("source"), F.col("description"))
    if moved is None:
        return rows.withColumn("description_id", own)
    other = moved.select("source", "description", F.col("description_id").alias("_moved"))
    found = rows.join(other, ["source", "description"], "left")
    return found.withColumn("description_id", F.coalesce("_moved", own)).drop("_moved")


def free_ids(new: DataFrame, known: DataFrame, stage: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Names ``new`` (none of them in ``known``), each with an id that no other name has.

    Of names with one id a known one keeps it, or else the first by source and name. The others take their next
    attempt until all differ, so the same names on the same dimension always get the same ids.
    """
    taken = known.select("description_id", F.lit(True).alias("_taken"))
    for attempt in range(1, MOST_MOVES):
        first = new.groupBy("description_id").agg(F.min(F.struct("source", "description")).alias("_first"))
        rival = (F.col("source") != F.col("_first.source")) | (F.col("description") != F.col("_first.description"))
        judged = new.join(first, "description_id").join(taken, "description_id", "left")
        judged = stage(
            judged.select("description_id", "source", "description", (F.col("_taken").isNotNull() | rival).alias("_loses")),
            f"ids{attempt}",
        )
        if judged.filter("_loses").isEmpty():
            return judged.drop("_loses")
        again = keys.description_id(F.col("source"), F.col("description"), attempt)
        new = judged.withColumn("description_id", F.when(F.col("_loses"), again).otherwise(F.col("description_id"))).drop("_loses")
    raise ValueError(f"names without an id of their own after {MOST_MOVES} attempts")


def describe(descriptions: DataFrame, description_id: int | Column) -> tuple[str, str]:
    """(source, description for display) of one id; an unknown id is an error."""
    check_description_id(description_id)
    row = (
        descriptions.filter(F.col("description_id") == description_id)
        .select("source", clean_text(F.col("description")).alias("description"))
        .first()
    )
    if row is None:
        raise ValueError(f"Unknown description_id: {description_id}")
    return row["source"], row["description"]
