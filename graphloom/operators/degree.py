"""Degrees of all kinds, each in one aggregation over the ends of the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph

DEGREES = ("degree", "inDegree", "outDegree", "weightedDegree", "weightedInDegree", "weightedOutDegree")


def degrees(graph: Graph, columns: tuple[str, ...] = DEGREES) -> DataFrame:
    """(id, columns) of every vertex, 0 where no edge touches it. A loop counts at both of its ends. The ends are summed up by vertex
    before the shuffle, so hubs don't weigh more than other vertices."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(True).alias("out")), F.struct(F.col("dst").alias("id"), F.lit(False).alias("out"))))
    rows = graph.weights().select("weight", ends.alias("e")).select("e.id", "e.out", "weight")
    one, out = F.lit(1).cast("long"), F.col("out")
    sums = {
        "degree": one, "inDegree": F.when(~out, one), "outDegree": F.when(out, one),
        "weightedDegree": F.col("weight"), "weightedInDegree": F.when(~out, F.col("weight")), "weightedOutDegree": F.when(out, F.col("weight")),
    }
    found = rows.groupBy("id").agg(*(F.sum(sums[c]).alias(c) for c in columns))
    return graph.vertices.select("id").join(found, "id", "left").fillna(0, list(columns))
