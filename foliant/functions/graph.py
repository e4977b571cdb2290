"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.session import cut


def connected_components(edges: DataFrame, scope: str | None = None, max_rounds: int = 60) -> DataFrame:
    """(scope, id, component) for every id in ``edges`` (a, b), component = smallest id.

    Each round links every node's larger neighbours to its smallest one
    (large star), then every node's smaller neighbours to the smallest (small
    star); the graph becomes a set of stars in O(log n) rounds. A round is two
    aggregations with map-side minimum and two joins; rounds are cut by a
    checkpoint, and the loop ends when the edge set no longer changes.
    """
    keys = [scope] if scope else []
    links = edges.where(F.col("a") != F.col("b")).select(
        *keys, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    selfs = edges.where(F.col("a") == F.col("b")).select(*keys, F.col("a").alias("id"))
    links = cut(links.distinct())
    state = None
    for _ in range(max_rounds):
        both = links.unionByName(links.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where(F.col("v") > F.col("u"))
            .join(low, [*keys, "u"])
            .select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        )
        # Orient downwards; the node itself stays attached through its own edge.
        large = large.where(F.col("u") != F.col("v")).distinct()
        low = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, [*keys, "u"])
            .where(F.col("v") != F.col("m"))
            .select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select(*keys, "u", F.col("m").alias("v")))
        )
        links = cut(small.distinct())
        now = links.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(20,0)")).alias("h")
        ).first()
        if state == tuple(now):
            break
        state = tuple(now)
    else:
        raise RuntimeError(f"no convergence after {max_rounds} rounds")
    nodes = links.select(*keys, F.col("u").alias("id"), F.col("v").alias("component"))
    roots = links.select(*keys, F.col("v").alias("id"), F.col("v").alias("component"))
    alone = selfs.select(*keys, "id", F.col("id").alias("component"))
    return nodes.unionByName(roots).unionByName(alone).groupBy(*keys, "id").agg(
        F.min("component").alias("component")
    )
