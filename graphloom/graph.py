"""A property graph: a frame of vertices keyed by `id`, a frame of directed edges keyed by `src` and `dst`."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ends(edges: DataFrame) -> DataFrame:
    """The ends of edges, each once, by one pass over them."""
    return edges.select(F.explode(F.array(F.col("src").cast("long"), F.col("dst").cast("long"))).alias("id")).distinct()


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame
    directed: bool = True
    weighted: bool = True

    @classmethod
    def of_edges(cls, edges: DataFrame, **flags: bool) -> Graph:
        """A graph of edges alone; its vertices are their ends."""
        return cls(_ends(edges), edges, **flags)

    def with_(self, **parts) -> Graph:
        return replace(self, **parts)

    def map_vertices(self, **columns: Column) -> Graph:
        return self.with_(vertices=self.vertices.withColumns(columns))

    def map_edges(self, **columns: Column) -> Graph:
        return self.with_(edges=self.edges.withColumns(columns))

    def weights(self, missing: int = 1) -> DataFrame:
        """(src, dst, weight) with the default where an edge has none."""
        weight = F.coalesce(F.col("weight").cast("long"), F.lit(missing)) if "weight" in self.edges.columns else F.lit(missing).cast("long")
        return self.edges.select("src", "dst", weight.alias("weight"))

    def triplets(self) -> DataFrame:
        """Edges with the columns of both ends, prefixed src_ and dst_."""
        ends = {side: self.vertices.select(*(F.col(c).alias(side if c == "id" else f"{side}_{c}") for c in self.vertices.columns)) for side in ("src", "dst")}
        return self.edges.join(ends["src"], "src").join(ends["dst"], "dst")

    def subgraph(self, keep: Column) -> Graph:
        """The vertices that satisfy a predicate and the edges between them."""
        return self.induced(self.vertices.where(keep))

    def induced(self, vertices: DataFrame) -> Graph:
        ids = vertices.select("id")
        edges = self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return self.with_(vertices=vertices, edges=edges.select(*self.edges.columns))

    def drop_isolated(self) -> Graph:
        """Without the vertices that no edge touches."""
        return self.with_(vertices=self.vertices.join(_ends(self.edges), "id", "left_semi"))

    def dangling(self) -> DataFrame:
        """Ends of edges that are no vertices."""
        return _ends(self.edges).join(self.vertices.select("id"), "id", "left_anti")

    def validate(self) -> Graph:
        if not self.dangling().isEmpty():
            raise ValueError("edges have ends that are no vertices")
        return self
