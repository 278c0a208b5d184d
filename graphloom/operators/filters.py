"""Range filters on metrics. A filter keeps the vertices in its range and the edges between them; metrics keep their values."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..graph import Graph


@dataclass(frozen=True)
class RangeFilter:
    column: str
    low: float | None = None
    high: float | None = None

    def predicate(self) -> Column:
        c = F.col(self.column)
        parts = [c >= self.low] if self.low is not None else []
        parts += [c <= self.high] if self.high is not None else []
        return reduce(Column.__and__, parts, c.isNotNull())


def filtered(graph: Graph, filters: list[RangeFilter]) -> Graph:
    """All filters at once, which is the same as one after the other. A metric that was not computed is an error."""
    lacking = [f.column for f in filters if f.column not in graph.vertices.columns]
    if lacking:
        raise ValueError(f"no such metric in the graph: {', '.join(lacking)}")
    distinct = list(dict.fromkeys(filters))
    return graph.subgraph(reduce(Column.__and__, (f.predicate() for f in distinct))) if distinct else graph
