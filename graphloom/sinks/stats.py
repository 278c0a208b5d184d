"""The statistics file of a job."""

from __future__ import annotations

from ..graph import Graph
from ..operators.metrics import by_column
from ..operators.statistics import report
from .text import save_sections


def save_stats(graph: Graph, target: str) -> str:
    known = by_column()
    have = [c for c in graph.vertices.columns if c in known]
    lines = report(graph.vertices, [c for c in have if not known[c].cluster], [c for c in have if known[c].cluster], graph.vertices.count(), graph.edges.count())
    return save_sections([lines], target, graph.vertices.sparkSession)
