"""Integrity checks as queries: every check is a DataFrame of issues (code, path, message)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _issues(df: DataFrame, code: str, path: Column, message: str) -> DataFrame:
    return df.select(F.lit(code).alias("code"), path.cast("string").alias("path"), F.lit(message).alias("message"))


def dangling(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, code: str = "DANGLING") -> DataFrame:
    """Rows whose reference has no target."""
    keys = parent.select(F.col(parent_key).alias("__key")).where("__key is not null").distinct()
    lost = child.where(F.col(child_key).isNotNull()).join(keys, F.col(child_key) == F.col("__key"), "left_anti")
    return _issues(lost, code, F.col(child_key), f"{child_key} has no {parent_key}")


def duplicates(df: DataFrame, keys: list[str], code: str = "DUPLICATE") -> DataFrame:
    """Key tuples that occur more than once."""
    twice = df.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1")
    return _issues(twice, code, F.concat_ws("/", *keys), "occurs more than once")


def miscounted(parents: DataFrame, key: str, count: str, children: DataFrame, child_key: str, code: str = "ITEM_COUNT") -> DataFrame:
    """Parents whose stored count is not the number of their children."""
    real = children.groupBy(F.col(child_key).alias("__key")).agg(F.count("*").alias("__n"))
    joined = parents.join(real, F.col(key) == F.col("__key"), "left").where(F.coalesce("__n", F.lit(0)) != F.col(count))
    return _issues(joined, code, F.col(key), f"{count} differs from the number of members")


def row_rules(df: DataFrame, path: Column, rules: dict[str, Column]) -> DataFrame:
    """One pass of per-row rules: an issue for each rule that does not hold; a null outcome counts as a failure."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(code)) for code, rule in rules.items()]))
    return df.select(F.explode(failed).alias("code"), path.cast("string").alias("path"), F.lit("rule does not hold").alias("message"))


def tombstone_conflicts(df: DataFrame, key: str, tombstones: DataFrame, target: str = "target_id") -> DataFrame:
    """Rows that are present although withdrawn."""
    hit = df.join(tombstones.select(F.col(target).alias("__t")).distinct(), F.col(key) == F.col("__t"), "left_semi")
    return _issues(hit, "TOMBSTONE_CONFLICT", F.col(key), "is withdrawn")


def cyclic_nodes(edges: DataFrame, scratch, max_rounds: int = 1000) -> DataFrame:
    """Nodes on or behind a cycle of a directed graph (src -> dst), by peeling nodes without incoming edges.

    Meant for registries (concept trees): rounds are bounded by the longest path.
    """
    current = scratch.table(edges.select("src", "dst").distinct(), "dag-0")
    size = current.count()
    for k in range(1, max_rounds + 1):
        inner = current.join(current.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        current = scratch.table(inner, f"dag-{k}")
        now = current.count()
        if now == size or not now:
            break
        size = now
    return current.select(F.col("src").alias("node")).unionByName(current.select(F.col("dst").alias("node"))).distinct()


def fail_if_any(issues: DataFrame) -> DataFrame:
    """The issues; reading a row of them raises."""
    return issues.withColumn("message", F.raise_error(F.concat_ws(" ", "code", "path", "message")).cast("string"))
