"""Versioned snapshots: Parquet tables in a fresh directory, a manifest with row counts and roots, a pointer to the newest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators.grouping import tree_depth, tree_root


class SnapshotError(ValueError):
    """A snapshot that does not hold what its manifest says."""


def _record(df: DataFrame):
    return F.to_json(F.struct(*sorted(df.columns)))


def write(spark: SparkSession, root: str, version: str, tables: dict[str, tuple[DataFrame, list[str]]]) -> dict:
    """Writes tables (name -> frame, primary key) as version ``version``; the manifest comes last, so a failed write is
    never seen. Returns the manifest."""
    entries = {}
    for name, (df, key) in sorted(tables.items()):
        path = f"{root}/{version}/{name}"
        df.write.mode("overwrite").parquet(path)
        stored = spark.read.schema(df.schema).parquet(path)
        depth = tree_depth(stored.count())
        row = tree_root(stored, key, _record(stored), depth).first()
        entries[name] = {"primary_key": key, "n_rows": row["n_rows"] if row else 0, "root": row["root"] if row else "", "schema": df.schema.simpleString(), "depth": depth}
    manifest = {"version": version, "tables": entries}
    text = json.dumps(manifest, sort_keys=True, separators=(",", ":"))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/{version}/manifest")
    return manifest


def manifest(spark: SparkSession, root: str, version: str) -> dict:
    rows = spark.read.text(f"{root}/{version}/manifest").take(2)
    if len(rows) != 1:
        raise SnapshotError("a manifest is one line")
    return json.loads(rows[0]["value"])


def read(spark: SparkSession, root: str, version: str, name: str, verify: bool = True) -> DataFrame:
    """One table of a version; verification recounts rows, key uniqueness and the root."""
    entry = manifest(spark, root, version)["tables"].get(name)
    if entry is None:
        raise SnapshotError(f"no table {name}")
    df = spark.read.parquet(f"{root}/{version}/{name}")
    if verify:
        row = tree_root(df, entry["primary_key"], _record(df), entry["depth"]).first()
        twice = df.groupBy(*entry["primary_key"]).agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        if twice or (row["n_rows"] if row else 0) != entry["n_rows"] or (row["root"] if row else "") != entry["root"]:
            raise SnapshotError(f"{name} differs from its manifest")
    return df


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, sha256) of every file below a path, for comparing with a manifest of files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def pack_subset(memberships: DataFrame, items: DataFrame, collections: list[str]) -> DataFrame:
    """Items reachable from some collections; the few collections are literals, so the scan of memberships is pruned."""
    wanted = memberships.where(F.col("collection_id").isin(collections)).select(F.col("item_id").alias("id")).distinct()
    return items.join(wanted, "id", "left_semi")
