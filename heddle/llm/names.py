"""Names for helper columns that no column of a user's table has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spare(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns_of(df: DataFrame) -> list[Column]:
    """All columns by quoted name, so that dots and the like in names do no harm."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
