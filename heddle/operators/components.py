"""Connected components by alternating large-star and small-star joins; nothing is collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.runtime import Scratch


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every greater neighbour of a node moves to the least of the node and its neighbours."""
    pairs = _both_ways(edges)
    least = pairs.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
    return pairs.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its lesser neighbours (edges point downwards) all move to the least of them."""
    least = edges.groupBy("src").agg(F.min("dst").alias("m"))
    moved = edges.join(least, "src").where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return moved.unionByName(least.select("src", F.col("m").alias("dst"))).distinct()


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 40) -> DataFrame:
    """``(node, component)`` for every node in ``edges(src, dst)``; component is the least node reachable.

    Each round joins edges with one row per node, so a node with a third of all edges is split by skew handling, and
    writes its edges to the shared folder. Self-loops make a component of one; null ends are ignored.
    """
    edges = edges.where("src is not null and dst is not null")
    current = scratch.table(edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "cc-0")
    loops = current.where("src = dst").select("src", "dst")
    state = None
    for k in range(1, max_rounds + 1):
        current = scratch.table(_small_star(_large_star(current.where("src <> dst"))), f"cc-{k}")
        now = current.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    else:
        raise RuntimeError("connected components did not settle")
    roots = current.select(F.col("dst").alias("node")).unionByName(loops.select(F.col("dst").alias("node"))).distinct()
    named = current.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return named.unionByName(roots.join(named, "node", "left_anti").select("node", F.col("node").alias("component")))
