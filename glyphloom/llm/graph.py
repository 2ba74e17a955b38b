"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


#: Edges that one task writes, about. Changes no result: small graphs are written by few tasks.
EDGES_A_TASK = 500_000


def _smallest(edges: DataFrame, of: str, among: str, tasks: int) -> DataFrame:
    """For each ``of`` the smallest neighbour; staged, so that a join with it can split hot nodes."""
    return staged(edges.groupBy(F.col(of).alias("at")).agg(F.min(among).alias("low")).coalesce(tasks), "stars")


def _mark(edges: DataFrame):
    return edges.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """(node, root): each node of an edge list with the smallest node that it reaches. Reads a staged table.

    Alternates large and small stars (Kiveris et al., 2014): each node links its larger
    neighbours, then itself and its smaller ones, to the smallest it knows, until nothing
    changes. No node's edges come together in one task.
    """
    now = staged(edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where("u < v").distinct(), name)
    mark = _mark(now)
    while True:
        tasks = 1 + 2 * mark[0] // EDGES_A_TASK
        # Large star: both directions; links larger neighbours to the node's smallest (itself included).
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = _smallest(both, "x", "y", tasks)
        large = both.where("y > x").join(low, both["x"] == low["at"]).select(F.col("y").alias("v"), F.least("x", "low").alias("u")).distinct()
        large = staged(large.coalesce(tasks), name)
        discard(now, low)
        # Small star: each node with its smaller neighbours only.
        low = _smallest(large, "v", "u", tasks)
        joined = large.join(low, large["v"] == low["at"])
        small = joined.select(F.col("u").alias("v"), F.col("low").alias("u")).where("u < v").unionByName(low.select(F.col("at").alias("v"), F.col("low").alias("u"))).distinct()
        now = staged(small.coalesce(tasks), name)
        discard(large, low)
        last, mark = mark, _mark(now)
        if mark == last:
            roots = now.select(F.col("v").alias("node"), F.col("u").alias("root"))
            return roots.unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
