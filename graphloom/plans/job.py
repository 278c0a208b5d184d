"""A whole job: source, graph, giant component, metrics, filters, statistics, export."""

from __future__ import annotations

import logging
import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import TypeVar

from pyspark.sql import SparkSession

from ..functions.scalar import time_text
from ..graph import Graph
from ..operators.components import giant_component
from ..operators.filters import filtered
from ..operators.metrics import computed, validate
from ..session import cut
from ..sinks.stats import save_stats
from . import networks
from .config import NetworkConfig

log = logging.getLogger(__name__)
T = TypeVar("T")


@dataclass
class Result:
    graph: Graph
    graph_file: str
    stats_file: str
    seconds: dict[str, float] = field(default_factory=dict)

    def summary(self) -> str:
        return "\n".join(f"{k}: {time_text(1000 * s)}" for k, s in self.seconds.items())

    def lineage(self) -> str:
        """Columns, partitions and plans of the graph."""
        out = []
        for what, df in (("vertices", self.graph.vertices), ("edges", self.graph.edges)):
            out += [f"{what}: {df.rdd.getNumPartitions()} partitions, columns {', '.join(df.columns)}", df._jdf.queryExecution().simpleString()]
        return "\n".join(out)


def run(spark: SparkSession, config: NetworkConfig) -> Result:
    """Metrics are validated before anything is read. Stored graphs keep their isolated vertices and their edges as they are."""
    network = networks.network(config.type)
    validate(config.metrics, network.directed, network.weighted)
    load, (save, ending) = networks.source(config.datasource), networks.exporter(config.exporter)
    seconds: dict[str, float] = {}

    def timed(what: str, f: Callable[[], T]) -> T:
        began = time.perf_counter()
        out = f()
        seconds[what] = time.perf_counter() - began
        log.info("%s: %s", what, time_text(1000 * seconds[what]))
        return out

    def build() -> Graph:
        g = load(spark, config, network)
        return g.with_(vertices=cut(g.vertices), edges=cut(g.edges))

    graph = timed("graph", build)
    if config.giant_component:
        graph = timed("giant component", lambda: giant_component(graph))
    graph = computed(graph, config.metrics, config, timed)
    graph = filtered(graph, list(config.filters))
    graph = graph.with_(vertices=timed("metrics and filters", lambda: cut(graph.vertices)))
    base = os.path.join(config.output, config.type)
    stats = timed("statistics", lambda: save_stats(graph, f"{base}.stats"))
    timed("export", lambda: save(graph, f"{base}.{ending}"))
    return Result(graph, f"{base}.{ending}", stats, seconds)
