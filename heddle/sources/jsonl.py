"""Strict JSON lines: bounded, typed, with malformed rows counted or refused."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Longest line in bytes, longest string value.
MAX_LINE, CORRUPT = 1 << 20, "_corrupt_record"


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed rows; any malformed one fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_counting(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(typed rows, malformed lines): for public data whose bad rows are counted and skipped."""
    typed = T.StructType(T._parse_datatype_string(schema).fields + [T.StructField(CORRUPT, T.StringType())])
    lines = spark.read.text(path)
    parsed = lines.select(F.from_json("value", typed, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"), "value")
    bad = F.col(f"r.{CORRUPT}").isNotNull() | (F.octet_length("value") > MAX_LINE) | F.startswith(F.col("value"), F.lit("﻿"))
    good = parsed.where(~bad).select("r.*").drop(CORRUPT)
    return good, parsed.where(bad).select("value")


def line_issues(spark: SparkSession, path: str) -> DataFrame:
    """Lines that break framing: empty, with a carriage return, too long, or with a byte-order mark."""
    lines = spark.read.option("lineSep", "\n").text(path)
    found = F.array_compact(
        F.array(
            F.when(F.col("value") == "", "BLANK"),
            F.when(F.contains("value", F.lit("\r")), "CARRIAGE_RETURN"),
            F.when(F.octet_length("value") > MAX_LINE, "TOO_LONG"),
            F.when(F.startswith(F.col("value"), F.lit("﻿")), "BYTE_ORDER_MARK"),
        )
    )
    return lines.select(F.explode(found).alias("code"), F.substring("value", 1, 80).alias("line"))


def write_canonical(df: DataFrame, path: str, order: list[str]) -> None:
    """Compact JSON lines with keys in order of their names, sorted by ``order``; nulls are left out."""
    columns = sorted(df.columns)
    df.orderBy(*order).select(F.to_json(F.struct(*columns)).alias("value")).write.mode("overwrite").text(path)
