"""The metrics by name: what each needs, which columns it fills, how it is computed."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..graph import Graph
from . import betweenness, centrality, components, degree, louvain


@dataclass(frozen=True)
class Metric:
    name: str
    columns: tuple[str, ...]
    compute: Callable[[Graph, object], DataFrame]
    directed: bool = False
    weighted: bool = False
    cluster: bool = False
    value: str | None = None  # the column that a filter or report looks at; groups have none


def _degrees(*columns: str) -> Callable[[Graph, object], DataFrame]:
    return lambda g, p: degree.degrees(g, columns)


REGISTRY: dict[str, Metric] = {}


def register_metric(metric: Metric) -> None:
    REGISTRY[metric.name] = metric


for _m in (
    Metric("DEGREE", ("degree",), _degrees("degree"), value="degree"),
    Metric("DEGREES", degree.DEGREES[:3], _degrees(*degree.DEGREES[:3]), directed=True),
    Metric("WEIGHTEDDEGREE", ("degree", "weightedDegree"), _degrees("degree", "weightedDegree"), weighted=True, value="weightedDegree"),
    Metric("WEIGHTEDDEGREES", degree.DEGREES, _degrees(*degree.DEGREES), directed=True, weighted=True),
    Metric("INDEGREE", ("inDegree",), _degrees("inDegree"), directed=True, value="inDegree"),
    Metric("OUTDEGREE", ("outDegree",), _degrees("outDegree"), directed=True, value="outDegree"),
    Metric("WEIGHTEDINDEGREE", ("weightedInDegree",), _degrees("weightedInDegree"), directed=True, weighted=True, value="weightedInDegree"),
    Metric("WEIGHTEDOUTDEGREE", ("weightedOutDegree",), _degrees("weightedOutDegree"), directed=True, weighted=True, value="weightedOutDegree"),
    Metric("EIGENCENTRALITY", ("eigenCentrality",), lambda g, p: centrality.eigenvector(g, p.eigen_iterations), value="eigenCentrality"),
    Metric("BETWEENNESSCENTRALITY", ("betweennessCentrality",), lambda g, p: betweenness.betweenness(g, betweenness.Settings(batch=p.betweenness_batch, most=p.betweenness_pivots)), value="betweennessCentrality"),
    Metric("PAGERANK", ("pageRank",), lambda g, p: centrality.pagerank(g, p.pagerank_reset, p.pagerank_tolerance, p.pagerank_iterations), directed=True, value="pageRank"),
    Metric("MODULARITY", ("modularity",), lambda g, p: louvain.communities(g, louvain.Settings(p.modularity_impl, p.modularity_use_weight, p.modularity_min_updates, p.modularity_resolution, p.modularity_increase, p.modularity_iterations)), cluster=True, value="modularity"),
    Metric("COMPONENT", ("component",), lambda g, p: components.components(g), cluster=True, value="component"),
):
    register_metric(_m)

ALL = ("MODULARITY", "EIGENCENTRALITY", "WEIGHTEDDEGREE", "COMPONENT", "PAGERANK")


def metric(name: str) -> Metric:
    found = REGISTRY.get(name.strip().upper())
    if found is None:
        raise ValueError(f"no such metric: {name}")
    return found


def validate(names: Sequence[str], directed: bool, weighted: bool) -> list[Metric]:
    found = [metric(n) for n in names]
    for m in found:
        if m.directed and not directed or m.weighted and not weighted:
            raise ValueError(f"{m.name} needs a {'directed' if m.directed and not directed else 'weighted'} network")
    return found


def computed(graph: Graph, names: Sequence[str], params: object, timed: Callable[[str, Callable[[], DataFrame]], DataFrame] | None = None) -> Graph:
    """The graph with the columns of each metric. A column that was there is computed anew."""
    vertices = graph.vertices
    for m in validate(names, graph.directed, graph.weighted):
        found = timed(m.name, lambda m=m: m.compute(graph, params)) if timed else m.compute(graph, params)
        vertices = vertices.drop(*m.columns).join(found.select("id", *m.columns), "id", "left")
    return graph.with_(vertices=vertices)


def by_column() -> Mapping[str, Metric]:
    return {m.value: m for m in REGISTRY.values() if m.value}
