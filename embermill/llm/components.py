"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, landed, salted


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each node's larger neighbours to the smallest of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    # the root of a large component has most of its nodes as neighbours
    return salted(both.where("b > a"), least, "a", "b", salts=8).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the smallest of them; edges come with a > b."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), roots included: root is the smallest node of the component.

    Alternates large and small stars, each round a written table that replaces the one before, until the edges no longer
    change; what remains are stars around the roots.  The number of rounds grows with the logarithm of the diameter.  Loops and repeated edges are allowed;
    nodes without a proper edge are not listed.
    """
    now = landed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())
        if mark == seen or not mark[0]:
            break
        seen = mark
        before, now = now, landed(_small_star(_large_star(now).distinct()).distinct(), "edges")
        dropped(before)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
