"""Eigenvector centrality and PageRank by rounds of joins and aggregations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..session import removed, renewed, scratch_path
from . import packed
from .pregel import Spread, iterate


def eigenvector(graph: Graph, iterations: int = 100, directed: bool | None = None, hub: int = 1_000_000, held: int = 4_000_000) -> DataFrame:
    """(id, eigenCentrality) after a fixed number of power rounds.

    A vertex adds what its in-neighbours (all neighbours, if undirected) hold to its own sum, and holds the sum divided by the largest
    one. Weights play no part; a vertex without edges, and every vertex of a graph whose sums are all 0, ends at 0. Up to `held`
    vertices the sums are an array, which the driver adds up from the tasks' shares; beyond it they are rows.
    """
    directed = graph.directed if directed is None else directed
    links = graph.edges.select("src", "dst")
    if not directed:
        links = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    links = renewed(links.groupBy("src", "dst").agg(F.count("*").alias("n")))
    touched = renewed(links.select(F.explode(F.array("src", "dst")).alias("id")).distinct())
    vertices = touched.count()
    found = _powers(links, touched, vertices, iterations) if 0 < vertices <= held else _powers_by_rows(links, touched, iterations, hub)
    return graph.vertices.select("id").join(found, "id", "left").fillna(0.0, ["eigenCentrality"])


def _powers(links: DataFrame, touched: DataFrame, vertices: int, iterations: int) -> DataFrame:
    """(id, eigenCentrality). A round is one job without a shuffle: a task for each file of edges, and 8 bytes a vertex both ways."""
    spark = links.sparkSession
    ids = packed.numbered(touched.select(F.col("id").alias("lot"), "id"))
    sides = {e: ids.select(F.col("id").alias(e), F.col("n").alias(k)) for e, k in (("src", "s"), ("dst", "t"))}
    files = packed.packed(links.withColumnRenamed("n", "w").join(sides["src"], "src").join(sides["dst"], "dst"), vertices, ("t", "s"), links.count())
    folder = scratch_path(spark, "sums")
    sums, hold = np.zeros(vertices), np.ones(vertices)

    def held(now: str) -> np.ndarray:
        return packed.kept(now, lambda: np.frombuffer(packed.load(now)))

    for n in range(iterations):
        now = f"{folder}/{n}"
        packed.save(now, hold)

        def share(k: int, now: str = now) -> tuple[int, np.ndarray]:
            s, t, w = files.read(k)
            return int(t[0]), np.bincount(t - t[0], held(now)[s] * w)

        for low, got in packed.over(spark, range(len(files.counts)), share):
            sums[low : low + len(got)] += got
        top = sums.max()
        hold = sums / top if top else np.zeros(vertices)
        removed(spark, now)
    last = f"{folder}/last"
    packed.save(last, hold)
    numbers = spark.range(0, vertices, 1, max(1, -(-vertices // packed.EDGES))).select(F.col("id").alias("n"))
    found = renewed(numbers.mapInArrow(lambda batches: packed.looked_up(batches, held(last)), "n long, x double").join(ids, "n").select("id", F.col("x").alias("eigenCentrality")))
    removed(spark, folder)
    packed.dropped(spark, files)
    return found


def _powers_by_rows(links: DataFrame, touched: DataFrame, iterations: int, hub: int) -> DataFrame:
    """(id, eigenCentrality) by joins of the edges with the sums."""
    spread = Spread(links, hub)
    state = touched.withColumn("u", F.lit(0.0))

    def held(top: float | None, first: bool) -> Column:
        return F.lit(1.0) if first else F.col("u") / F.lit(float(top)) if top else F.lit(0.0)

    def step(now: DataFrame, seen: dict) -> DataFrame:
        # the largest sum was observed while the last round computed the sums
        going = now.select(F.col("id").alias("src"), held(seen["top"], seen["n"] == 0).alias("hold"))
        got = spread.join(going).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("hold") * F.col("n")).alias("got"))
        return now.join(got, "id", "left").select("id", (F.col("u") + F.coalesce("got", F.lit(0.0))).alias("u"))

    def go_on(n: int, seen: dict) -> bool:
        seen["n"] = n
        return n < iterations

    out, _, seen = iterate(state, step, {"top": F.max("u")}, go_on)
    spread.close()
    value = held(seen["top"], iterations == 0)
    return out.select("id", value.alias("eigenCentrality"))


def pagerank(graph: Graph, reset: float = 0.15, tolerance: float = 0.01, iterations: int = 100, source: int | None = None, directed: bool | None = None, hub: int = 1_000_000) -> DataFrame:
    """(id, pageRank) by propagating changes: a vertex passes its last change on while this is above the tolerance and it has received
    something in the round before. Ranks add up to about the number of vertices; the rank of a vertex without out-edges is lost.

    With `source` the ranks are personal: only that vertex starts, with rank 1, and the reset goes to it alone.
    """
    directed = graph.directed if directed is None else directed
    links = graph.edges.select("src", "dst")
    ends = links.select("src") if directed else links.select(F.explode(F.array("src", "dst")).alias("src"))
    out = ends.groupBy("src").agg(F.count("*").alias("d"))
    shares = links.join(out, "src").groupBy("src", "dst").agg(F.sum(1 / F.col("d")).alias("share"))
    spread = Spread(shares, hub)
    start = F.lit(reset) if source is None else F.when(F.col("id") == source, 1.0).otherwise(0.0)
    state = graph.vertices.select("id").withColumn("pr", start).withColumn("delta", F.col("pr"))

    def step(now: DataFrame, _: dict) -> DataFrame:
        going = now.where(F.col("delta") > tolerance).select(F.col("id").alias("src"), "delta")
        got = spread.join(going).groupBy(F.col("dst").alias("id")).agg(((1 - reset) * F.sum(F.col("delta") * F.col("share"))).alias("more"))
        both = now.join(got, "id", "left")
        new = F.col("pr") + F.coalesce("more", F.lit(0.0))
        return both.select("id", new.alias("pr"), (new - F.col("pr")).alias("delta"))

    found, _, _ = iterate(state, step, {"going": F.count_if(F.col("delta") > tolerance)}, lambda n, seen: n < iterations and seen["going"] > 0)
    spread.close()
    return found.select("id", F.col("pr").alias("pageRank"))
