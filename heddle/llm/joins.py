"""Joins of all rows with one finding per key, however many rows hold a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of findings up to which they are broadcast.
BROADCAST_ROWS = 200_000
#: Beyond that: rows of one key from which the key is joined apart, by broadcast. Of n rows at most n / HOT_ROWS keys are.
HOT_ROWS = 100_000


def join_found(rows: DataFrame, key: str, found: DataFrame, found_key: str, few: bool) -> DataFrame:
    """``rows`` left-joined with ``found`` (at most one row for each key); ``few`` says that it may be broadcast."""
    on = F.col(key) == F.col(found_key)
    if few:
        return rows.join(F.broadcast(found), on, "left")
    hot = rows.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") >= HOT_ROWS).select(F.col(key).alias("__hot"))
    marked = rows.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("__hot")), "left")
    crowd = found.join(F.broadcast(hot), F.col(found_key) == F.col("__hot"), "left_semi")
    apart = marked.where("__hot is not null").join(F.broadcast(crowd), on, "left")
    return apart.unionByName(marked.where("__hot is null").join(found, on, "left")).drop("__hot")
