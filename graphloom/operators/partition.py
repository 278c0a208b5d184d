"""Where edges lie. Only performance depends on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRATEGIES = ("CanonicalRandomVertexCut", "RandomVertexCut", "EdgePartition1D", "EdgePartition2D")


def partitioned(edges: DataFrame, strategy: str = STRATEGIES[0], parts: int = 0) -> DataFrame:
    """Edges hashed by a strategy; an unknown one is the canonical one, under which both directions of a pair meet."""
    n = parts or int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if strategy == "EdgePartition1D":
        return edges.repartition(n, "src")
    if strategy == "RandomVertexCut":
        return edges.repartition(n, "src", "dst")
    if strategy == "EdgePartition2D":
        side = max(1, int(n**0.5))
        return edges.repartition(n, F.pmod(F.xxhash64("src"), F.lit(side)), F.pmod(F.xxhash64("dst"), F.lit(side)))
    return edges.repartition(n, F.least("src", "dst"), F.greatest("src", "dst"))


def input_partitioned(items: DataFrame, parts: int = 0) -> DataFrame:
    return items.repartition(parts) if parts else items
