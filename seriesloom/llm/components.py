"""Connected components of an edge table, by alternating large and small stars.

Every round joins and aggregates; nothing of the size of the graph reaches the driver. Rounds are few (they grow with
the logarithm of the longest chain) and each is cut off from the last by a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Neighbours above a node are hung on the least of its neighbours and itself."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return (both.where(F.col("b") > F.col("a")).join(least, "a")
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below it are hung on the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where(F.col("b") > F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(mixed.bitwiseAND(0xFFFFFFFF)), F.sum(F.shiftrightunsigned(mixed, 32))).first())


def components(edges: DataFrame) -> DataFrame:
    """a, b with a > b, both long, to the star of each component: a (node), b (its least node); none for least nodes."""
    edges = staged(edges.select("a", "b"), "edges")
    state = _state(edges)
    while state[0]:
        edges = staged(_small_star(_large_star(edges)), "edges")
        state, last = _state(edges), state
        if state == last:
            break
    return edges
