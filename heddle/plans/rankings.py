"""Latest picks, pages, intervals, order and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators.intervals import as_of, midpoints, presentation
from heddle.operators.ranking import chunks, keyset_page, latest, next_positions, order_breaks
from heddle.plans.catalogue import query
from heddle.runtime import Scratch, read_table


@query("""
SELECT o_custkey, o_orderkey, o_orderdate FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1""")
def latest_order_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest order of each customer; of equally new ones the least key."""
    orders = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return latest(orders, ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")])


@query("""
SELECT o_orderkey, o_custkey, o_orderstatus, (row_number() OVER (ORDER BY o_orderkey) - 1)::INTEGER AS ordinal
FROM orders WHERE o_orderkey > (SELECT max(o_orderkey) FROM orders WHERE o_orderkey <= 700) ORDER BY o_orderkey LIMIT 200""")
def keyset_page_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of orders after a key; the page size is the operator's own limit."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    last = orders.where("o_orderkey <= 700").agg(F.max("o_orderkey")).first()[0]
    return keyset_page(orders, ["o_orderkey"], (last,), 200)


@query("""
SELECT event_id, user_id, epoch_us(ts) AS valid_from, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS valid_until
FROM events""")
def event_presentation_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event lasts until its user's next one; microseconds since 1970."""
    events = read_table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return presentation(events, ["user_id"], "us", "event_id").select("event_id", "user_id", "valid_from", "valid_until")


@query("""
WITH i AS (SELECT user_id, event_id, event_type, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until FROM events),
p AS (SELECT DISTINCT user_id, d AS probe FROM events, (VALUES (TIMESTAMP '2024-01-08 00:00:00'), (TIMESTAMP '2024-01-20 12:00:00')) AS v(d))
SELECT p.user_id, epoch_us(probe) AS probe_us, event_id, event_type FROM p JOIN i ON p.user_id = i.user_id AND ts <= probe AND (until IS NULL OR probe < until)""")
def resolve_interval_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each user at two instants."""
    events = read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    instants = [F.unix_micros(F.to_timestamp(F.lit(t))) for t in ("2024-01-08 00:00:00", "2024-01-20 12:00:00")]
    probes = events.select("user_id").distinct().select("user_id", F.explode(F.array(*instants)).alias("probe_us"))
    return as_of(presentation(events, ["user_id"], "us", "event_id"), probes, ["user_id"], "probe_us").select("user_id", "probe_us", "event_id", "event_type")


@query("""
WITH u AS (SELECT user_id, min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM events GROUP BY 1)
SELECT user_id, k::INTEGER AS sample, a + ((2 * k + 1) * (b - a)) // 32 AS at_us FROM u, unnest(range(16)) AS t(k)""")
def midpoint_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen midpoints of each user's span."""
    events = read_table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    spans = events.groupBy("user_id").agg(F.min("us").alias("a"), F.max("us").alias("b"))
    return spans.select("user_id", F.posexplode(midpoints(F.col("a"), F.col("b"))).alias("sample", "at_us"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, previous FROM (
  SELECT *, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS previous FROM lineitem)
WHERE previous >= l_linenumber""")
def sort_order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order that are not in strictly rising order of number, when read in order of part."""
    lines = read_table(spark, sf_dir, "lineitem")
    keyed = lines.withColumn("__order", F.struct("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"))
    return order_breaks(keyed, ["l_orderkey"], "l_linenumber", "__order").select("l_orderkey", "l_linenumber", "l_partkey", "previous")


@query("""
SELECT conv_id, turn, role, ((row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1) // 7)::BIGINT AS chunk FROM conversations""")
def conversation_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each role in chunks of seven."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return chunks(turns, ["role"], [F.col("conv_id"), F.col("turn")], 7, Scratch(spark, "chunks"))


@query("""
WITH t AS (SELECT conv_id, max(turn) AS top FROM conversations WHERE turn < 2 GROUP BY 1)
SELECT c.conv_id, c.turn AS old_turn, coalesce(top, -1) + row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) AS position
FROM conversations c LEFT JOIN t USING (conv_id) WHERE c.turn >= 2""")
def free_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later turns appended after the first two of their conversation."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("old_turn"))
    there = turns.where("old_turn < 2").select("conv_id", F.col("old_turn").alias("position"))
    return next_positions(there, "conv_id", "position", turns.where("old_turn >= 2"), ["old_turn"])


@query("""
SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles, count(*) AS members, min(turn) AS first_turn, max(turn) AS last_turn
FROM conversations GROUP BY 1""")
def conversation_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as ordered memberships."""
    turns = read_table(spark, sf_dir, "conversations")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role")))
    grouped = turns.groupBy("conv_id").agg(ordered.alias("m"), F.count("*").alias("members"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))
    return grouped.select("conv_id", F.array_join(F.transform("m", lambda x: x["role"]), ">").alias("roles"), "members", "first_turn", "last_turn")
