"""Connected components with DataFrame operations only: alternating large and small stars.

Each round turns every node's neighbours to the smallest one it knows, first the larger neighbours, then the smaller
ones. Only smallest values are aggregated, which combine before the shuffle, and the joins back are plain equi-joins
that adaptive execution splits when a hub has many edges. Each round is a table in the shared folder, so a lost
executor costs a part of one round; the tables of earlier rounds are deleted. The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _stars(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs: (u, v); for large stars in both directions, for small stars from the larger node to the smaller."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    turned = pairs.join(low, "u")
    if large:
        return turned.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return turned.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v")


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; a component is named by its smallest node.

    Rows with a null end are ignored, loops and repeated edges are harmless, no edges give no rows.
    """
    u, v = F.col(a), F.col(b)
    start = edges.where(u.isNotNull() & v.isNotNull()).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
    nodes = start.where("u = v").select("u").distinct()
    loops = written(nodes, "loops")
    now = written(start.where("u <> v").distinct(), "edges")
    seen = _print(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        wide = written(_stars(both, True).distinct(), "stars")
        down = wide.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        before, now = now, written(_stars(down, False).distinct(), "edges")
        discard(wide, before)
        was, seen = seen, _print(now)
        if seen == was:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    found = found.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    alone = loops.withColumnRenamed("u", "node").join(found, "node", "left_anti")
    return found.union(alone.select("node", F.col("node").alias("component")))
