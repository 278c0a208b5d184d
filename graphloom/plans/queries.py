"""Queries over the driver's tables, one or more for each graph operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..graph import Graph
from ..operators import betweenness as bc
from ..operators import centrality, components, construction, degree, filters, louvain, partition, pregel, statistics
from ..operators.metrics import computed
from ..session import cut, removed, scratch_path, written
from ..sinks import csv as csv_sink
from ..sinks.gexf import save_gexf
from ..sinks.jsonl import save_jsonl
from ..sinks.stats import save_stats
from ..sources.gexf import read_gexf
from ..sources.items import sampled
from ..sources.jsonl import read_jsonl
from . import adapters, sql
from .config import NetworkConfig
from .networks import AuthorNetwork, EgoNetwork

_found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _found[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_found)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in sql.QUERIES.items() if k in _found}


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


def _config(**more) -> NetworkConfig:
    return NetworkConfig("AuthorNetwork", "-", "-", **more)


# ---- construction


@query
def build_edges_merge(spark, sf_dir):
    return construction.merged_edges(adapters.trade_rows(spark, sf_dir))


@query
def vertex_aggregate(spark, sf_dir):
    items = construction.author_items(adapters.event_items(spark, sf_dir))
    found = construction.merged_vertices(construction.author_vertices(items))
    return found.select("id", "nickName", "activity", "rating", "firstItemDate", "lastItemDate", "urlNumber", "domainNumber", "parentData")


@query
def author_network_edges(spark, sf_dir):
    return AuthorNetwork().build(adapters.event_items(spark, sf_dir)).edges


@query
def ego_vertices(spark, sf_dir):
    found = EgoNetwork().build(adapters.event_items(spark, sf_dir)).vertices
    return found.select("id", "nickId", "nickName", "activity", "rating", "firstItemDate", "lastItemDate", "urlNumber", "domainNumber", "parentData")


@query
def ego_edges(spark, sf_dir):
    return EgoNetwork().build(adapters.event_items(spark, sf_dir)).edges


@query
def ego_expand(spark, sf_dir):
    return construction.ego_expansion(adapters.event_items(spark, sf_dir), ego=3, k=5).select("item_id", "nick_id", "item_parentNickId")


@query
def drop_isolated(spark, sf_dir):
    customers = adapters.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return Graph(customers, adapters.trade_rows(spark, sf_dir)).drop_isolated().vertices  # parallel edges have the same ends as merged ones


@query
def dangling_ends(spark, sf_dir):
    customers = adapters.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return Graph(customers, adapters.trade_rows(spark, sf_dir)).dangling()


@query
def partitioned_edges(spark, sf_dir):
    """For each strategy over four partitions: edges and weight, and whether all edges of a key lie in as few partitions as they should."""
    edges = cut(adapters.flow(spark, sf_dir).edges)
    keys = {"CanonicalRandomVertexCut": (["least(src, dst)", "greatest(src, dst)"], 1), "RandomVertexCut": (["src", "dst"], 1), "EdgePartition1D": (["src"], 1), "EdgePartition2D": (["src"], 2)}
    frames, tasks = [], int(spark.conf.get("spark.sql.shuffle.partitions"))
    for s in partition.STRATEGIES:
        key, most = keys[s]
        placed = partition.partitioned(edges, s, 4).withColumn("part", F.spark_partition_id())
        placed = placed.repartition(tasks, *(F.expr(k) for k in key))  # a quarter of all edges is too much to aggregate in one task
        by = placed.groupBy(*(F.expr(k).alias(f"k{i}") for i, k in enumerate(key))).agg(F.count_distinct("part").alias("parts"), F.count("*").alias("n"), F.sum("weight").alias("w"))
        frames.append(by.agg(F.lit(s).alias("strategy"), F.sum("n").alias("edges"), F.sum("w").alias("weight"), (F.max("parts") <= most).alias("together")))
    return statistics.union_all(frames)


@query
def triplets(spark, sf_dir):
    g = adapters.flow(spark, sf_dir)
    g = g.map_vertices(parity=F.col("id") % 2).map_edges(weight=F.col("weight") * 2)
    return g.triplets().select("src", "dst", "weight", "src_parity", "dst_parity")


# ---- degrees, filters, statistics


@query
def degrees(spark, sf_dir):
    return degree.degrees(adapters.flow(spark, sf_dir), degree.DEGREES[:3])


@query
def degree_only(spark, sf_dir):
    return degree.degrees(adapters.flow(spark, sf_dir), ("degree",))


@query
def weighted_degree(spark, sf_dir):
    return degree.degrees(adapters.trade(spark, sf_dir), ("degree", "weightedDegree"))


@query
def weighted_degrees(spark, sf_dir):
    return degree.degrees(adapters.trade(spark, sf_dir))


def _measured(spark, sf_dir) -> Graph:
    return computed(adapters.trade(spark, sf_dir), ["WEIGHTEDDEGREES"], _config())


@query
def metric_filter_subgraph(spark, sf_dir):
    return filters.filtered(_measured(spark, sf_dir), [filters.RangeFilter("degree", 5, None)]).edges.select("src", "dst", "weight")


@query
def filter_chain(spark, sf_dir):
    chain = [filters.RangeFilter("degree", 2, 1000), filters.RangeFilter("weightedInDegree", None, 40), filters.RangeFilter("degree", 2, 1000)]
    return filters.filtered(_measured(spark, sf_dir), chain).vertices


@query
def top_vertices(spark, sf_dir):
    return statistics.top_vertices(_measured(spark, sf_dir).vertices, "weightedDegree", 25)


@query
def summary_stats(spark, sf_dir):
    return _round(statistics.summary(_measured(spark, sf_dir).vertices, ["degree", "weightedDegree", "inDegree"]), "mean", "variance")


@query
def sign_buckets(spark, sf_dir):
    """How far a vertex's weighted in-degree is from its out-degree, by sign."""
    v = _measured(spark, sf_dir).vertices
    return statistics.sign_counts(v.select("id", (F.col("weightedInDegree") - F.col("weightedOutDegree") - 15).alias("balance")), "balance")


@query
def quantiles(spark, sf_dir):
    return statistics.quantiles(_measured(spark, sf_dir).vertices, "weightedDegree", 4)


@query
def percentile_fences(spark, sf_dir):
    return statistics.fences(statistics.percentiles(_measured(spark, sf_dir).vertices, "weightedDegree"), 100)


@query
def histogram(spark, sf_dir):
    return _round(statistics.histogram(_measured(spark, sf_dir).vertices, "degree", 20, 0.0, 60.0), "start")


@query
def global_rank(spark, sf_dir):
    return statistics.ranked(_measured(spark, sf_dir).vertices.select("id", "weightedDegree"), "weightedDegree").select("id", "rank")


@query
def sampled_scan(spark, sf_dir):
    """How many documents a sample of 20 has, how many different ones, and how many of these the table has."""
    items = adapters.event_items(spark, sf_dir)
    taken = sampled(items, 20, seed=3).select("item_id")
    there = taken.join(items.select("item_id"), "item_id", "left_semi").agg(F.count("*").alias("known"))
    return taken.agg(F.count("*").alias("n"), F.count_distinct("item_id").alias("different")).crossJoin(there)  # one row each


@query
def union_distinct(spark, sf_dir):
    return Graph.of_edges(adapters.flow(spark, sf_dir).edges).vertices


@query
def dedup_first(spark, sf_dir):
    items = adapters.event_items(spark, sf_dir).select("item_id", "nick_id")
    return construction.once(items.unionByName(items.where("nick_id % 2 = 0")))


@query
def scalar_functions(spark, sf_dir):
    e = adapters.table(spark, sf_dir, "events")
    raw, ms = F.concat(F.lit('<a b="'), F.col("event_type"), F.lit('">&')), adapters.millis(e, "ts")
    shown = scalar.shown_date(ms)
    return e.select("event_id", scalar.escaped(raw).alias("xml"), shown.alias("day"), scalar.read_date(shown).alias("back"), scalar.first_of(F.concat(F.col("event_type"), F.lit("||x"))).alias("head"), scalar.last_of(F.concat(F.col("event_type"), F.lit("||x"))).alias("tail"), scalar.zero(F.lit(None)).alias("none"))


# ---- graph algorithms


@query
def eigen_centrality(spark, sf_dir):
    return _round(centrality.eigenvector(adapters.flow(spark, sf_dir)), "eigenCentrality")


@query
def eigen_centrality_undirected(spark, sf_dir):
    return _round(centrality.eigenvector(adapters.flow(spark, sf_dir), directed=False), "eigenCentrality")


@query
def pagerank(spark, sf_dir):
    return _round(centrality.pagerank(adapters.flow(spark, sf_dir)), "pageRank")


@query
def personalized_pagerank(spark, sf_dir):
    return _round(centrality.pagerank(adapters.flow(spark, sf_dir), tolerance=0.0001, source=1), "pageRank")


@query
def connected_components(spark, sf_dir):
    return components.components(adapters.geography(spark, sf_dir))


@query
def giant_component(spark, sf_dir):
    return components.giant_component(adapters.geography(spark, sf_dir)).edges


@query
def top_clusters(spark, sf_dir):
    return statistics.top_clusters(components.components(adapters.geography(spark, sf_dir)), "component")


@query
def pregel_hops(spark, sf_dir):
    """Steps from user 1 to every user, by a vertex program."""
    g = adapters.flow(spark, sf_dir)
    far = F.lit(1_000_000).cast("long")
    start = {"hops": F.when(F.col("id") == 1, F.lit(0).cast("long")).otherwise(far), "moved": F.col("id") == 1}
    update = {"hops": F.least("hops", F.coalesce("msg", far)), "moved": F.coalesce("msg", far) < F.col("hops")}
    return pregel.pregel(g, start, F.col("hops") + 1, F.min, update, F.col("moved"), 20).select("id", "hops")


@query
def louvain_communities(spark, sf_dir):
    return louvain.communities(adapters.flow(spark, sf_dir))


@query
def louvain_compat(spark, sf_dir):
    return louvain.communities(adapters.flow(spark, sf_dir), louvain.Settings("compat"))


@query
def modularity_score(spark, sf_dir):
    g = adapters.geography(spark, sf_dir)
    return _round(louvain.modularity_score(g, components.components(g).withColumnRenamed("component", "modularity")), "q")


@query
def betweenness(spark, sf_dir):
    """Exact: every vertex is a pivot."""
    return _round(bc.betweenness(adapters.flow(spark, sf_dir), bc.EXACT), "betweennessCentrality")


@query
def high_betweenness_set(spark, sf_dir):
    return _round(bc.high_betweenness_set(adapters.flow(spark, sf_dir), bc.EXACT), "betweennessCentrality")


@query
def betweenness_of_pivot(spark, sf_dir):
    """What the shortest paths from the user of the least id give to each vertex."""
    g = adapters.flow(spark, sf_dir)
    pivot = g.vertices.orderBy("id").limit(1)
    return _round(bc.dependencies(g, cut(pivot)), "value").where("value > 0")


@query
def betweenness_of_samples(spark, sf_dir):
    """From pivots drawn in rounds, until the vertices of the highest values settle."""
    return _round(bc.betweenness(adapters.flow(spark, sf_dir)), "betweennessCentrality")


# ---- sinks and sources


def _stored(spark, sf_dir) -> Graph:
    """Its vertices and edges are merged once, though metrics are taken of them too."""
    network = EgoNetwork().build(adapters.event_items(spark, sf_dir))
    g = computed(network.with_(vertices=cut(network.vertices), edges=cut(network.edges)), ["DEGREES", "COMPONENT"], _config())
    return g.with_(vertices=cut(g.vertices))


def _back(spark: SparkSession, name: str, read: Callable[[str], DataFrame]) -> DataFrame:
    """What is read from a file in the shared folder, which then goes."""
    folder = scratch_path(spark, "export")
    out, _ = written(read(f"{folder}/{name}"), "read-back")
    removed(spark, folder)
    return out


@query
def gexf_roundtrip(spark, sf_dir):
    g = _stored(spark, sf_dir)
    return _back(spark, "g.gexf", lambda f: read_gexf(spark, save_gexf(g, f)).vertices.select("id", "nickName", "urlNumber", "domainNumber", "degree", "inDegree", "outDegree", "component"))


@query
def gexf_roundtrip_edges(spark, sf_dir):
    g = _stored(spark, sf_dir)
    return _back(spark, "g.gexf", lambda f: read_gexf(spark, save_gexf(g, f)).edges.select("src", "dst", "weight", "firstItemBody", "lastItemBody", "firstItemLink", "lastItemLink"))


@query
def jsonl_roundtrip(spark, sf_dir):
    g = _stored(spark, sf_dir)
    return _back(spark, "g.json", lambda f: read_jsonl(spark, save_jsonl(g, f)).edges)


@query
def jsonl_roundtrip_vertices(spark, sf_dir):
    """Those with dates: people who are only mentioned have none, and a stored vertex needs them."""
    g = _stored(spark, sf_dir)
    return _back(spark, "g.json", lambda f: read_jsonl(spark, save_jsonl(g, f)).vertices.select("id", "nickName", "activity", "rating", "firstItemDate", "lastItemDate", "urlNumber", "domainNumber", "degree", "component"))


@query
def csv_export(spark, sf_dir):
    """Edges of the second file; how often an id occurs tells whether ids are unique."""
    g = _stored(spark, sf_dir)

    def read(target: str) -> DataFrame:
        _, edges = csv_sink.save_csv(g, target)
        rows = spark.read.option("sep", ";").option("header", True).schema("Source long, Target long, Type string, Id long, Weight long, Label string, firstItemBody string, firstItemLink string, lastItemLink string").csv(edges)
        rows = rows.join(rows.groupBy("Id").agg(F.count("*").alias("ids")), "Id")
        return rows.select(F.col("Source").alias("src"), F.col("Target").alias("dst"), F.col("Type").alias("type"), F.col("Weight").alias("weight"), F.col("Label").alias("label"), "ids")

    return _back(spark, "g", read)


@query
def csv_export_nodes(spark, sf_dir):
    g = _stored(spark, sf_dir)
    g = g.with_(vertices=g.vertices.select("id", "nickName", "activity", "degree", "inDegree", "outDegree", "component"))

    def read(target: str) -> DataFrame:
        nodes, _ = csv_sink.save_csv(g, target)
        rows = spark.read.option("sep", ";").option("header", True).option("enforceSchema", False).schema("Id long, Label string, activity long, degree long, inDegree long, outDegree long, component long").csv(nodes)
        return rows.select(F.col("Id").alias("id"), F.col("Label").alias("label"), "activity", "degree", "inDegree", "outDegree", "component")

    return _back(spark, "g", read)


@query
def job_statistics(spark, sf_dir):
    """The first lines of the statistics file of a graph: numbers of vertices and edges, and what metrics come to."""
    g = _measured(spark, sf_dir)
    g = g.with_(vertices=cut(g.vertices))

    def read(target: str) -> DataFrame:
        save_stats(g, target)
        lines = spark.read.text(target)
        parts = F.regexp_extract_all("value", F.lit(r"=(-?[0-9.E]+|None)"), 1)
        heads = lines.where(F.col("value").rlike("^(vertices|edges): ")).select(F.split("value", ": ")[0].alias("name"), F.split("value", ": ")[1].cast("double").alias("value"))
        sums = lines.where(F.col("value").rlike(r"^\w+: count=")).select(F.regexp_extract("value", r"^(\w+):", 1).alias("m"), parts.alias("p"))
        named = [sums.select(F.concat("m", F.lit(f" {c}")).alias("name"), F.round(F.col("p")[k].cast("double"), 6).alias("value")) for k, c in enumerate(("count", "mean", "max", "min", "variance", "non_zeros"))]
        return statistics.union_all([heads, *named])

    return _back(spark, "g.stats", read)
