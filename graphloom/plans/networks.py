"""The kinds of networks, and the registry of networks, sources and exporters by name."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..graph import Graph
from ..operators import construction as c
from ..operators.partition import input_partitioned, partitioned
from ..sinks.csv import save_csv
from ..sinks.gexf import save_gexf
from ..sinks.jsonl import save_jsonl
from ..sources.gexf import read_gexf
from ..sources.items import expanded, read_items, sampled
from ..sources.jsonl import read_jsonl
from .config import ConfigError, NetworkConfig


class Network(ABC):
    """How documents become a graph."""

    directed = True
    weighted = True

    @abstractmethod
    def build(self, items: DataFrame, config: NetworkConfig) -> Graph: ...

    def items(self, spark: SparkSession, config: NetworkConfig) -> DataFrame:
        found = read_items(spark, config.connection)
        found = sampled(found, config.sample_size) if config.sample else found
        return input_partitioned(found, config.partition_number)

    def graph(self, vertices: DataFrame, edges: DataFrame, config: NetworkConfig | None) -> Graph:
        g = Graph(vertices, edges, self.directed, self.weighted)
        if config is None:
            return g
        if config.partition_number:
            g = g.with_(edges=partitioned(edges, config.partition_strategy, config.partition_number))
        return g.drop_isolated() if config.drop_isolated else g


class AuthorNetwork(Network):
    """Authors, and who answers whom."""

    def build(self, items: DataFrame, config: NetworkConfig | None = None) -> Graph:
        rows = c.author_items(items)
        return self.graph(c.merged_vertices(c.author_vertices(rows)), c.merged_edges(c.author_edges(rows)), config)


class EgoNetwork(Network):
    """Authors around one of them: who answers, mentions and replies to whom."""

    def items(self, spark: SparkSession, config: NetworkConfig) -> DataFrame:
        """With an ego, two scans: its own documents, then those of the authors in them who were active last. A search engine gets both
        as queries, so that it only gives out what is asked for."""
        found = super().items(spark, config)
        if not config.ego:
            return found
        if ";" not in config.connection:
            return c.ego_expansion(found, config.ego, config.ego_relations)
        people = [r["id"] for r in c.latest_authors(found, config.ego_relations).collect()]  # as many as the setting says
        if not people:
            return found
        more = read_items(spark, expanded(config.connection, people))
        return c.once(found.unionByName(input_partitioned(more, config.partition_number)))

    def build(self, items: DataFrame, config: NetworkConfig | None = None) -> Graph:
        rows = c.ego_items(items)
        vertices = c.merged_vertices(c.ego_vertices(rows))
        return self.graph(vertices.withColumn("nickId", vertices["id"]), c.merged_edges(c.ego_edges(rows)), config)


Source = Callable[[SparkSession, NetworkConfig, Network], Graph]
Exporter = Callable[[Graph, str], object]

_networks: dict[str, Callable[[], Network]] = {}
_sources: dict[str, Source] = {}
_exporters: dict[str, tuple[Exporter, str]] = {}


def register_network(name: str, make: Callable[[], Network]) -> None:
    _networks[name] = make


def register_source(name: str, load: Source) -> None:
    _sources[name] = load


def register_exporter(name: str, save: Exporter, ending: str) -> None:
    _exporters[name] = save, ending


def _documents(spark: SparkSession, config: NetworkConfig, network: Network) -> Graph:
    return network.build(network.items(spark, config), config)


register_network("AuthorNetwork", AuthorNetwork)
register_network("EgoNetwork", EgoNetwork)
for _name in ("Elastic", "Items"):
    register_source(_name, _documents)
register_source("Gephi", lambda spark, config, _: read_gexf(spark, config.connection))
register_source("Json", lambda spark, config, _: read_jsonl(spark, config.connection))
register_exporter("Gephi", save_gexf, "gexf")
register_exporter("Json", save_jsonl, "json")
register_exporter("Csv", save_csv, "csv")


def _found(table: dict, name: str, what: str, *drop: str):
    for d in drop:
        name = name.removesuffix(d)
    for k, v in table.items():
        if name.lower() in (k.lower(), *(f"{n}{k}".lower() for n in _networks)):
            return v
    raise ConfigError(f"no such {what}: {name}")


def network(name: str) -> Network:
    return _found(_networks, name, "network")()


def source(name: str) -> Source:
    return _found(_sources, name, "source", "DataSource", "Source")


def exporter(name: str) -> tuple[Exporter, str]:
    return _found(_exporters, name, "exporter", "Exporter")
