"""Vertex programs as a loop of joins and aggregations.

The state is written out each round with a reliable checkpoint: a step reads it twice, so a plan that kept the round before would
double with every round, and a checkpoint survives lost executors. What a round's control needs is observed while the state is
computed, not by a job of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..session import observed

Watch = dict[str, Column]


def iterate(state: DataFrame, step: Callable[[DataFrame, dict], DataFrame], watch: Watch, go_on: Callable[[int, dict], bool]) -> tuple[DataFrame, int, dict]:
    """Apply `step` while `go_on(rounds so far, observed)`; the last state, the rounds and what was observed on it."""

    state, seen = observed(state, watch)
    rounds = 0
    while go_on(rounds, seen):
        rounds += 1
        state, seen = observed(step(state, seen), watch)
    return state, rounds, seen


HUBS = 10_000


class Spread:
    """Edges (src, ...) that are joined with one state after the other. They lie by source, so that a round shuffles the state only;
    edges of hubs stay spread over all tasks. A hub has more than `least` and more than one in HUBS of all edges, so that there are
    fewer than HUBS of them, and what is broadcast is that many rows of the state at most."""

    def __init__(self, links: DataFrame, least: int = 1_000_000):
        sizes = links.groupBy("src").agg(F.count("*").alias("n"))
        sizes, seen = observed(sizes, {"total": F.coalesce(F.sum("n"), F.lit(0)), "most": F.coalesce(F.max("n"), F.lit(0))})
        least = max(least, seen["total"] // HUBS)
        self.heavy = F.broadcast(sizes.where(F.col("n") > least).select("src")) if seen["most"] > least else None
        self.rest = (links if self.heavy is None else links.join(self.heavy, "src", "left_anti")).repartition("src").persist()
        self.hubs = None if self.heavy is None else links.join(self.heavy, "src", "left_semi").persist()

    def join(self, state: DataFrame) -> DataFrame:
        """The edges with the columns of the state (src, ...) of their source."""
        out = self.rest.join(state, "src")
        if self.hubs is not None:
            out = out.unionByName(self.hubs.join(F.broadcast(state.join(self.heavy, "src", "left_semi")), "src"))
        return out

    def close(self) -> None:
        self.rest.unpersist()
        if self.hubs is not None:
            self.hubs.unpersist()


def pregel(graph: Graph, initial: dict[str, Column], message: Column, merge: Callable[[Column], Column], update: dict[str, Column], active: Column, rounds: int, hub: int = 1_000_000) -> DataFrame:
    """A generic vertex program.

    State columns start as `initial` over the vertices. In each round every edge whose source is `active` (over the state) sends
    `message` (over the source's state and the edge's columns); `merge` adds up what a vertex receives in `msg`; `update` gives
    the new state over the old one and `msg`, which is null where nothing came. The program ends when nothing is active.
    """
    columns = list(initial)
    state = graph.vertices.select("id", *(c.alias(n) for n, c in initial.items()))
    edges = Spread(graph.edges, hub)

    def step(now: DataFrame, _: dict) -> DataFrame:
        sent = edges.join(now.where(active).withColumn("src", F.col("id"))).select(F.col("dst").alias("to"), message.alias("m"))
        got = sent.groupBy("to").agg(merge(F.col("m")).alias("msg"))
        return now.join(got, now["id"] == got["to"], "left").select("id", *(update.get(c, F.col(c)).alias(c) for c in columns))

    watch = {"active": F.count_if(active)}
    out, _, _ = iterate(state, step, watch, lambda n, seen: n < rounds and seen["active"] > 0)
    edges.close()
    return out
