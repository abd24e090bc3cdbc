"""Latest-record picks, top-k with overflow, keyset pages, chunks, order checks and positions."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.runtime import Scratch


def latest(df: DataFrame, identity: list[str], order: list[Column]) -> DataFrame:
    """The first row of each identity under a total order. Ties must be broken by the order given."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*identity).orderBy(*order)))
    return ranked.where("__rank = 1").drop("__rank")


def top_k(df: DataFrame, key: list[str], order: list[Column], k: int) -> DataFrame:
    """The k best rows of each key with their rank, the number there were, and whether that is more than k.

    The count is a separate aggregate with partial sums, so the ranking window may drop rows before the shuffle.
    """
    counts = df.groupBy(*key).agg(F.count("*").alias("available"))
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= k)
    return ranked.join(counts, key).withColumn("overflow", F.col("available") > k)


class CursorError(ValueError):
    """A cursor that does not belong to the rows it is used on."""


def keyset_page(df: DataFrame, keys: list[str], after: tuple | None, limit: int) -> DataFrame:
    """The next ``limit`` rows after a key tuple, in key order, and whether more follow (one row beyond is read). The tuple must
    be one of the rows', as a cursor from another domain would silently skip rows."""
    if after is not None:
        beyond, equal = F.lit(False), F.lit(True)
        for name, value in zip(keys, after, strict=True):
            beyond = beyond | (equal & (F.col(name) > F.lit(value)))
            equal = equal & (F.col(name) == F.lit(value))
        if df.where(equal).isEmpty():
            raise CursorError(f"no row has the key {after}")
        df = df.where(beyond & (F.col(keys[0]) >= F.lit(after[0])))
    page = df.orderBy(*keys).limit(limit + 1)
    numbered = page.withColumn("ordinal", F.row_number().over(Window.orderBy(*keys)) - 1)  # limit + 1 rows
    return numbered.where(F.col("ordinal") < limit)


def _dealt(df: DataFrame, total: list[Column], weight: Column, scratch: Scratch) -> DataFrame:
    """``df`` with ``__before``, the weight of all rows that stand before it in a total order. Rows are dealt by ranges of the
    order and written; a row's sum is that within its partition plus what the partitions before it hold, so no task holds
    more than a range."""
    place = F.monotonically_increasing_id()
    ranges = df.withColumn("__weight", weight).repartitionByRange(*total).sortWithinPartitions(*total)
    written = scratch.table(ranges.withColumn("__part", F.shiftright(place, 33)).withColumn("__place", place), f"dealt-{uuid.uuid4().hex}")
    parts = written.groupBy("__part").agg(F.sum("__weight").alias("__sum"))  # one row per partition
    upto = F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("__weight").over(Window.partitionBy("__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = written.withColumn("__inside", inside).join(F.broadcast(parts.select("__part", upto.alias("__upto"))), "__part")
    return joined.withColumn("__before", F.col("__upto") + F.col("__inside")).drop("__part", "__place", "__inside", "__upto")


def running(df: DataFrame, by: list[str], order: list[Column], weight: Column, scratch: Scratch, name: str) -> DataFrame:
    """``df`` with ``name``: the weight of the rows of its ``by`` group that stand before it, however large the group is."""
    dealt = _dealt(df, [*[F.col(c) for c in by], *order], weight, scratch).drop("__weight")
    if not by:
        return dealt.withColumnRenamed("__before", name)
    firsts = dealt.groupBy(*by).agg(F.min("__before").alias("__first"))
    same = reduce(lambda a, b: a & b, [F.col(f"n.{c}").eqNullSafe(F.col(f"f.{c}")) for c in by])
    joined = dealt.alias("n").join(firsts.alias("f"), same).select("n.*", "f.__first")
    return joined.withColumn(name, F.col("__before") - F.col("__first")).drop("__before", "__first")


def ordinals(df: DataFrame, order: list[Column], scratch: Scratch, name: str = "ordinal", by: list[str] | None = None) -> DataFrame:
    """``df`` with a contiguous number from 0 in a total order, within each ``by`` if given."""
    return running(df, by or [], order, F.lit(1).cast("long"), scratch, name)


def chunks(df: DataFrame, strata: list[str], order: list[Column], size: int, scratch: Scratch) -> DataFrame:
    """Rows of each stratum in order, in chunks of a fixed size; a stratum may hold any number of rows."""
    numbered = ordinals(df, order, scratch, "__nth", strata)
    return numbered.withColumn("chunk", F.floor(F.col("__nth") / size).cast("long")).drop("__nth")


def order_breaks(df: DataFrame, partition: list[str], column: str, order: str) -> DataFrame:
    """Rows whose value is not strictly greater than the one before them."""
    before = F.lag(column).over(Window.partitionBy(*partition).orderBy(order))
    return df.withColumn("previous", before).where(F.col("previous") >= F.col(column))


def next_positions(members: DataFrame, collection: str, position: str, added: DataFrame, order: list[str]) -> DataFrame:
    """``added`` rows with free positions after the greatest one occupied in their collection."""
    top = members.groupBy(collection).agg(F.max(position).alias("__top"))
    nth = F.row_number().over(Window.partitionBy(collection).orderBy(*order))
    return added.join(top, collection, "left").withColumn(position, F.coalesce("__top", F.lit(-1)) + nth).drop("__top")
