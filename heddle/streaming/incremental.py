"""Incremental state: upsert of changed records by digest in micro-batches, and windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def state_digest(df: DataFrame, columns: list[str]):
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def changed(current: DataFrame, state: DataFrame | None, key: str, columns: list[str]) -> DataFrame:
    """Rows whose digest is not the one in ``state`` (key, digest)."""
    marked = current.withColumn("digest", state_digest(current, columns))
    if state is None:
        return marked
    return marked.join(state.select(key, "digest"), [key, "digest"], "left_anti")


def affected(changed_items: DataFrame, old_pairs: DataFrame, new_pairs: DataFrame) -> DataFrame:
    """Changed items and their old and new neighbours: what a near-duplicate index must scan again."""
    pairs = old_pairs.select("left", "right").unionByName(new_pairs.select("left", "right"))
    both = pairs.unionByName(pairs.select(F.col("right").alias("left"), F.col("left").alias("right")))
    near = both.join(changed_items.select(F.col("item").alias("left")), "left", "left_semi").select(F.col("right").alias("item"))
    return changed_items.select("item").unionByName(near).distinct()


def upsert_stream(stream: DataFrame, spark: SparkSession, target: str, key: str, order: str, columns: list[str], checkpoint: str):
    """Keeps the newest state of each key: batch n reads version n-1 of ``target`` and writes version n, so a replayed
    batch gives the same result. Returns the query."""

    def merge(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(order)).alias("s"), F.max(order).alias(order)).select(key, "s.*", order)
        if number:
            old = spark.read.parquet(f"{target}/{number - 1}")
            both = old.unionByName(newest)
            newest = both.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(order)).alias("s"), F.max(order).alias(order)).select(key, "s.*", order)
        newest.write.mode("overwrite").parquet(f"{target}/{number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, ts: str, key: str, size: str, lateness: str) -> DataFrame:
    """Counts per tumbling window and key, with a bound on late data."""
    return stream.withWatermark(ts, lateness).groupBy(F.window(ts, size), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")
