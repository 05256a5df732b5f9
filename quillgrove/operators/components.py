"""Connected components over an edge table, by alternating star contractions.

Each round is two group-and-join steps that replace a node's edges by edges to
the smallest neighbour, so chains halve and hubs never gather their neighbours
in one task: the minimum is a partial aggregate, and the join on a hub's key is
one that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quillgrove.session import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # every edge already points from the larger u to the smaller v
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    pulled = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return pulled.union(low.select("u", F.col("m").alias("v"))).distinct()


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table, and their number and sum of hashes, taken while they are written."""
    seen = Observation()
    table = materialize(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "edges")
    return table, (seen.get["n"], seen.get["sum"])


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 40) -> DataFrame:
    """``(node, component)`` for every node of an edge; component = smallest node id.

    Nulls and self-loops are dropped, repeated edges count once, an empty edge
    table gives an empty result.  Isolated nodes do not appear: callers join
    left and fall back to the node's own id.
    """
    u, v = F.col(a), F.col(b)
    start = edges.where(u.isNotNull() & v.isNotNull() & (u != v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
    now, mark = _written(start.distinct())
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        after, next_mark = _written(_small_star(_large_star(now)))
        discard(now)
        now, settled, mark = after, mark == next_mark, next_mark
        if settled:
            break
    else:
        raise RuntimeError(f"connected components did not settle in {max_rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
