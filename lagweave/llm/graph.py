"""Connected components of a graph that is held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, kept, shuffled

#: Edges that a task writes in a round, about.
TASK_EDGES = 100_000


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, component (its smallest node) of every node of edges (a, b); nodes of no edge aren't in it.

    Large-star and small-star steps by turns, until the edges stay the same: the
    number of rounds grows with the logarithm of the longest path, and each round
    shuffles the edges. Minima are pre-aggregated, so a node of any degree is no
    special case; the joins leave large keys to be split, and none of many edges is a
    broadcast. Each round is written to the shared folder.
    """
    def check(e: DataFrame) -> tuple:
        # Halves of the sum, which can't overflow.
        r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").bitwiseAND(0xFFFFFF)), F.sum(F.shiftrightunsigned(F.xxhash64("b", "a"), 40))).first()
        return tuple(r)

    def ordered(e: DataFrame) -> DataFrame:
        return e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    now = kept(ordered(edges), name)
    seen = check(now)
    number = seen[0]  # rounds add no edges
    tasks = int(number // TASK_EDGES) + 1
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = ordered(both.join(shuffled(least, number), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(shuffled(least, number), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        after = kept(ordered(small).coalesce(tasks), name)
        then = check(after)
        dropped(now)
        now = after
        if then == seen:
            break
        seen = then
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component")))
