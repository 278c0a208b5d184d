"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..session import renewed


def _star(edges: DataFrame, least: DataFrame, keep_greater: bool) -> DataFrame:
    """Hang the neighbours of each node on its least neighbour."""
    both = edges.join(least, "u")
    if keep_greater:
        return both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    return both.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_pairs(pairs: DataFrame, most: int = 60) -> DataFrame:
    """(id, component) of every id that occurs in a pair (u, v) of two different ids; a component is named by its least id.

    Each round is two shuffles of the remaining edges, which shrink towards one star per component; the number of rounds grows
    with the logarithm of the longest path. Hubs are split by adaptive execution, as the joins are plain equi-joins.
    """
    edges = pairs.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v")
    edges = renewed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    last = None
    for _ in range(most):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _star(both, least, True)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = renewed(_star(large, least, False))
        now = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31))).alias("h"), F.sum("v").alias("s")).head()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    roots = edges.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def components(graph: Graph) -> DataFrame:
    """(id, component) of every vertex; directions play no part, a vertex without edges is a component of its own."""
    found = connected_pairs(graph.edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    return graph.vertices.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def giant_component(graph: Graph) -> Graph:
    """The vertices and edges of the largest component; among equals that of the least id."""
    found = renewed(components(graph))
    largest = found.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1).select("component")
    keep = found.join(F.broadcast(largest), "component", "left_semi").select("id")  # one row
    return graph.induced(graph.vertices.join(keep, "id", "left_semi"))
