"""Alignment of hash sequences and of media sets, in columns."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions.columns import hamming64

#: Fixed value: most media of an item that are paired by trying all orders.
MOST_MEDIA = 8


def best_shift(left: Column, right: Column) -> Column:
    """(shift, total): the rotation of ``right`` whose summed distance to ``left`` is least, the smallest of equal ones; null
    where the sequences differ in length or are empty."""
    n = F.size(left)

    def total(shift: Column) -> Column:
        turned = F.concat(F.slice(right, shift + 1, n), F.slice(right, F.lit(1), shift))
        return F.aggregate(F.zip_with(left, turned, lambda a, b: hamming64(a, b)), F.lit(0), lambda s, x: s + x)

    options = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(total(k).alias("total"), k.alias("shift")))
    best = F.array_min(options)
    return F.when((n > 0) & (n == F.size(right)), F.struct(best["shift"].alias("shift"), best["total"].alias("total")))


def text_conflict(left: Column, right: Column) -> Column:
    """Whether both sides hold texts and they differ."""
    return (F.size(left) > 0) & (F.size(right) > 0) & (left != right)


def media_bijection(pairs: DataFrame, item: str) -> DataFrame:
    """The best one-to-one pairing of two items' media, for each ``item`` key.

    ``pairs`` has ``n_left``, ``n_right`` and ``cost``, an array with a row for each left medium of its cost against each right
    one (null: they cannot be paired). Both sides must be equally many, MOST_MEDIA at most; the pairing with the least sum
    wins, of equal ones the first in order. ``pairing`` is null where there is none.
    """
    out = None
    for n in range(1, MOST_MEDIA + 1):
        rows = pairs.where((F.col("n_left") == n) & (F.col("n_right") == n))
        if n <= 4:  # few orders: written out as columns
            options = [F.struct(sum((F.get(F.get("cost", F.lit(i)), F.lit(j)) for i, j in enumerate(order)), F.lit(0)).alias("total"), F.array(*[F.lit(j) for j in order]).alias("pairing")) for order in permutations(range(n))]
            best = F.array_min(F.filter(F.array(*options), lambda o: o["total"].isNotNull()))
            found = rows.select(item, best["total"].cast("long").alias("total"), best["pairing"].alias("pairing"))
        else:
            found = rows.select(item, _assigned("cost").alias("b")).select(item, F.col("b.total").alias("total"), F.col("b.pairing").alias("pairing"))
        out = found if out is None else out.unionByName(found)
    rest = pairs.where((F.col("n_left") != F.col("n_right")) | (F.col("n_left") > MOST_MEDIA) | (F.col("n_left") < 1))
    none = rest.select(item, F.lit(None).cast("long").alias("total"), F.lit(None).cast("array<int>").alias("pairing"))
    return out.unionByName(none)


@F.udf("struct<total:bigint,pairing:array<int>>")
def _assigned(cost):
    """The least assignment by dynamic programming over sets of used columns."""
    n = len(cost)
    best: dict[int, tuple[int, list[int]]] = {0: (0, [])}
    for row in cost:
        step: dict[int, tuple[int, list[int]]] = {}
        for used, (total, pairing) in best.items():
            for j in range(n):
                if not used >> j & 1 and row[j] is not None:
                    new = (total + row[j], [*pairing, j])
                    if used | 1 << j not in step or new < step[used | 1 << j]:
                        step[used | 1 << j] = new
        best = step
    return best.get((1 << n) - 1)
