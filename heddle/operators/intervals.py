"""Half-open intervals: from events, as-of look-ups and midpoint samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def presentation(df: DataFrame, key: list[str], ts: str, tie: str, end: Column | None = None) -> DataFrame:
    """``valid_from`` and ``valid_until``: each row lasts until the next of its key; the last until ``end`` (or open)."""
    following = F.lead(ts).over(Window.partitionBy(*key).orderBy(ts, tie))
    return df.withColumn("valid_from", F.col(ts)).withColumn("valid_until", F.coalesce(following, end) if end is not None else following)


def as_of(intervals: DataFrame, probes: DataFrame, key: list[str], instant: str) -> DataFrame:
    """Probes joined with the interval that holds their instant: ``valid_from <= t < valid_until`` (open if null)."""
    t = F.col(instant)
    joined = probes.join(intervals, key, "left")
    return joined.where((F.col("valid_from") <= t) & (F.col("valid_until").isNull() | (t < F.col("valid_until"))))


def midpoints(start: Column, stop: Column, n: int = 16) -> Column:
    """n instants at the middles of n equal parts of [start, stop), in integers rounded down."""
    span = stop - start
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (start + F.floor((2 * k + 1) * span / F.lit(2 * n))).cast("long"))


def presented(starts: DataFrame, finishes: DataFrame) -> DataFrame:
    """(media, frame, start, stop, finish) of frames given by (media, start): each lasts until the next, the last until its
    medium's finish. A medium has few frames, so they are ordered in one window each."""
    window = Window.partitionBy("media").orderBy("start")
    rows = starts.join(finishes, "media").withColumn("frame", F.row_number().over(window) - 1)
    return rows.withColumn("stop", F.coalesce(F.lead("start").over(window), F.col("finish")))


def held_at(frames: DataFrame, n: int = 16) -> DataFrame:
    """(media, sample, frame): the frame that is held at the middle of each of n equal parts of [0, finish), by exact integers:
    the middle of part i is (2 i + 1) finish / 2 n."""
    samples = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("sample")
    rows = frames.select("media", "frame", "start", "stop", "finish", samples)
    middle = (2 * F.col("sample") + 1) * F.col("finish")
    return rows.where((middle >= 2 * n * F.col("start")) & (middle < 2 * n * F.col("stop"))).select("media", "sample", "frame")


def frame_issues(frames: DataFrame) -> DataFrame:
    """(media, code): presentations whose first frame is not at 0, or with a frame that does not start after the one before."""
    before = F.lag("start").over(Window.partitionBy("media").orderBy("index"))
    rows = frames.withColumn("__before", before)
    late = rows.groupBy("media").agg(F.min_by("start", "index").alias("first"), F.bool_or(F.coalesce(F.col("__before") >= F.col("start"), F.lit(False))).alias("back"))
    codes = F.array_compact(F.array(F.when(F.col("first") != 0, F.lit("FIRST_NOT_ZERO")), F.when(F.col("back"), F.lit("NOT_INCREASING"))))
    return late.select("media", F.explode(codes).alias("code"))
