"""Connected components by alternating large-star and small-star steps.

(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014.) Every step is
a minimum per node, which is aggregated before the shuffle, and a join; neighbours are
never gathered. Each round is checkpointed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgetide.session import cut


def _all_stars(pairs: DataFrame) -> bool:
    """True when every node hangs on one root and no root hangs on another node."""
    ends = pairs.select(F.col("x").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        pairs.select("y", F.lit(0), F.lit(1)))
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.filter("up > 1 OR (up > 0 AND down > 0)").count() == 0


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.union(pairs.select("y", "x"))
    least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
    return both.filter("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y"))


def _small_star(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("x").agg(F.min("y").alias("m"))
    moved = pairs.join(least, "x").filter("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
    return moved.union(least.select("x", F.col("m").alias("y"))).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the component is its smallest node. Self edges give nodes."""
    ends = edges.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y"))
    pairs = ends.filter("x <> y")
    while True:
        pairs = cut(_small_star(_large_star(pairs)))
        if _all_stars(pairs):
            break
    named = ends.select(F.col("x").alias("node"), F.col("x").alias("component")).union(ends.select("y", "y")).union(pairs)
    return named.groupBy("node").agg(F.min("component").alias("component"))
