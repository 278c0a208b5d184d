"""Betweenness from a sample of pivots: shortest paths from each, then dependencies back along them.

Pivots are shared out among tasks. A task holds the edges as flat arrays and goes with several pivots at a time from round to round until
no path gets shorter, then through the vertices in the order of their paths and back; only sums by vertex leave it. Where the arrays
would take more than `Settings.held` bytes, all states are rows (pivot, vertex, ...) instead, so that a round is one join with the edges
and one aggregation, for all pivots of a batch at once. Weights are lengths; 0 counts as 1. Each pivot's dependencies add up without
scaling; with every vertex a pivot the result is the exact betweenness.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..session import renewed
from . import packed


@dataclass(frozen=True)
class Settings:
    batch: int = 16  # pivots of a round
    most: int | None = 64  # no further round beyond so many pivots; None: all vertices are pivots
    top: int = 20  # the set that has to settle
    changes: int = 2  # settled: at most so many new vertices in it
    supersteps: int | None = None  # an error if paths of more edges come up
    seed: int = 1
    held: int = 640 << 20  # bytes of a graph in a task


EXACT = Settings(batch=256, most=None)


def _distances(edges: DataFrame, pivots: DataFrame, s: Settings) -> DataFrame:
    """(pivot, v, dist) by relaxing only what changed in the last superstep."""
    best = renewed(pivots.select(F.col("id").alias("pivot"), F.col("id").alias("v"), F.lit(0).cast("long").alias("dist")))
    front = best
    steps = 0
    while not front.isEmpty():
        if s.supersteps is not None and steps >= s.supersteps:
            raise RuntimeError(f"shortest paths have more than {s.supersteps} edges")
        steps += 1
        reached = front.join(edges, front["v"] == edges["src"]).groupBy("pivot", F.col("dst").alias("v")).agg(F.min(F.col("dist") + F.col("w")).alias("new"))
        both = best.join(reached, ["pivot", "v"], "full").withColumn("changed", F.col("dist").isNull() | (F.col("new") < F.col("dist")))
        both = renewed(both.select("pivot", "v", F.when(F.col("changed"), F.col("new")).otherwise(F.col("dist")).alias("dist"), "changed"))
        best, front = both.drop("changed"), both.where("changed").drop("changed")
    return best


def _rounds(start: DataFrame, links: DataFrame) -> DataFrame:
    """Σ over j of links^j applied to start (pivot, v, x); links (pivot, a, b, f), which have no cycle, carry x from a to b times f."""
    total, now = start, start
    for k in count(1):
        now = renewed(links.join(now, (links["pivot"] == now["pivot"]) & (links["a"] == now["v"])).groupBy(links["pivot"], F.col("b").alias("v")).agg(F.sum(F.col("x") * F.col("f")).alias("x")))
        if now.isEmpty():
            break
        total = total.unionByName(now)
        if k % 8 == 0:
            total = renewed(total)
    return renewed(total.groupBy("pivot", "v").agg(F.sum("x").alias("x")))


SLOTS, VISITS = 1 << 20, 1 << 21


class _Paths:
    """Shortest paths from several pivots at a time. The state of vertex v for the k-th pivot is in slot k * n + v."""

    def __init__(self, rows: packed.Rows, supersteps: int | None):
        self.rows, self.n, self.supersteps = rows, len(rows.start) - 1, supersteps
        self.at_once = max(1, min(SLOTS // max(1, self.n), 2 * VISITS // max(1, len(rows.t))))
        slots = self.at_once * self.n
        self.dist, self.sigma, self.delta = np.empty(slots, np.int64), np.empty(slots), np.empty(slots)
        self.left, self.mark = np.empty(slots, np.int32), np.empty(slots, np.int32)
        self.given, self.reached = np.zeros(self.n), np.zeros(self.n, bool)

    def _visits(self, slots: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place in slots, slot of the other end, weight) of the edges from some slots, VISITS or those of one slot at a time."""
        v = slots % self.n
        first = self.rows.start[v]
        size = self.rows.start[v + 1] - first
        total = np.cumsum(size)
        at = 0
        while at < len(slots):
            base = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, base + VISITS, "right")))
            n = size[at:to]
            place = np.repeat(np.arange(at, to, dtype=np.int32), n)
            edge = np.arange(total[to - 1] - base) + np.repeat(first[at:to] - (total[at:to] - n - base), n)
            yield place, (slots - v)[place] + self.rows.t[edge], self.rows.w[edge]
            at = to

    def _once(self, slots: np.ndarray) -> np.ndarray:
        self.mark[slots] = np.arange(len(slots), dtype=np.int32)
        return slots[self.mark[slots] == np.arange(len(slots))]

    def _distances(self, pivots: np.ndarray) -> np.ndarray:
        """Fills the distances, relaxing only what changed in the last superstep; the slots that are reached."""
        self.dist[:] = np.iinfo(np.int64).max
        self.dist[pivots] = 0
        front, seen, steps = pivots, [pivots], 0
        while len(front):
            if self.supersteps is not None and steps >= self.supersteps:
                raise RuntimeError(f"shortest paths have more than {self.supersteps} edges")
            steps += 1
            from_, changed = self.dist[front], []
            for place, to, w in self._visits(front):
                new = from_[place] + w
                better = np.flatnonzero(new < self.dist[to])
                to, new = to[better], new[better]
                changed.append(to)
                seen.append(self._once(to[self.dist[to] == np.iinfo(np.int64).max]))
                np.minimum.at(self.dist, to, new)
            front = self._once(np.concatenate(changed)) if changed else front[:0]
        return np.concatenate(seen)

    def _links(self, slots: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place in slots, slot of the other end) of the edges that shortest paths take."""
        for place, to, w in self._visits(slots):
            on = np.flatnonzero(self.dist[slots][place] + w == self.dist[to])
            yield place[on], to[on]

    def add(self, vertices: np.ndarray) -> None:
        """Adds what the shortest paths from some vertices, `at_once` at most, give to each."""
        pivots = np.arange(len(vertices)) * self.n + vertices
        seen = self._distances(pivots)
        self.left[seen], self.sigma[seen], self.delta[seen] = 0, 0.0, 0.0
        self.sigma[pivots] = 1.0
        for _, to in self._links(seen):
            np.add.at(self.left, to, np.int32(1))
        layers, front = [], pivots
        while len(front):  # a vertex comes up when all before it on its paths have
            layers.append(front)
            reached = []
            for place, to in self._links(front):
                np.add.at(self.sigma, to, self.sigma[front][place])
                np.subtract.at(self.left, to, np.int32(1))
                reached.append(self._once(to[self.left[to] == 0]))
            front = np.concatenate(reached) if reached else front[:0]
        for front in reversed(layers):
            for place, to in self._links(front):
                np.add.at(self.delta, front[place], self.sigma[front][place] / self.sigma[to] * (1.0 + self.delta[to]))
        others = seen[len(pivots) :]
        self.reached[others % self.n] = True
        np.add.at(self.given, others % self.n, self.delta[others])


def _lengths(graph: Graph) -> DataFrame:
    return graph.weights().where("src <> dst").groupBy("src", "dst").agg(F.min(F.when(F.col("weight") == 0, 1).otherwise(F.col("weight"))).alias("w"))


class _Given:
    """A graph for dependencies from pivots, as files that tasks hold, if these are small enough. Vertices are numbered in the order in
    which they are drawn, ends of edges that are no vertices after them."""

    def __init__(self, graph: Graph, s: Settings):
        self.edges, self.s = renewed(_lengths(graph)), s
        lots = F.xxhash64(F.lit(s.seed), "id").alias("lot")
        own = renewed(graph.vertices.select(lots, F.col("id").cast("long").alias("id")))
        more = self.edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(own, "id", "left_anti").select(lots, "id")
        self.vertices, self.ids = own.count(), packed.numbered(own, more)
        n, size = self.ids.count(), self.edges.count()
        self.files = None
        if 12 * size + 64 * n <= s.held:
            sides = {e: self.ids.select(F.col("id").alias(e), F.col("n").alias(k)) for e, k in (("src", "s"), ("dst", "t"))}
            self.files = packed.packed(self.edges.join(sides["src"], "src").join(sides["dst"], "dst").select("s", "t", "w"), n, ("s", "t"), size)
        self.tasks = 4 * self.edges.sparkSession.sparkContext.defaultParallelism

    def by(self, pivots: DataFrame) -> DataFrame:
        """(id, value): what the shortest paths from some vertices give to each vertex that they reach."""
        if self.files is None:
            return _by_rows(self.edges, pivots, self.s)
        numbers = renewed(self.ids.join(pivots.select("id"), "id", "left_semi").select("n"))
        return self._by_files(numbers.repartition(max(1, min(numbers.count(), self.tasks))))

    def drawn(self, start: int, end: int) -> DataFrame:
        """The same from the vertices of these places in the order of drawing."""
        if self.files is None:
            return self.by(self.ids.where((F.col("n") >= start) & (F.col("n") < end)))
        return self._by_files(self.ids.sparkSession.range(start, end, 1, max(1, min(end - start, self.tasks))).withColumnRenamed("id", "n"))

    def _by_files(self, numbers: DataFrame) -> DataFrame:
        files, supersteps = self.files, self.s.supersteps

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            paths = None
            for batch in batches:
                vertices = batch.column("n").to_numpy()
                if len(vertices):
                    paths = paths or _Paths(packed.kept(files.folder, lambda: packed.Rows.of(files)), supersteps)
                    for at in range(0, len(vertices), paths.at_once):
                        paths.add(vertices[at : at + paths.at_once])
            if paths:
                there = np.flatnonzero(paths.reached)
                for at in range(0, len(there), 1 << 16):
                    part = there[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_pydict({"n": pa.array(part), "value": pa.array(paths.given[part])})

        found = numbers.mapInArrow(work, "n long, value double").groupBy("n").agg(F.sum("value").alias("value"))
        return renewed(found.join(self.ids, "n").select("id", "value"))

    def close(self) -> None:
        if self.files is not None:
            packed.dropped(self.ids.sparkSession, self.files)


def _by_rows(edges: DataFrame, pivots: DataFrame, s: Settings) -> DataFrame:
    edges = edges.persist()
    dist = _distances(edges, pivots, s)
    ends = dist.select("pivot", F.col("v").alias("dst"), F.col("dist").alias("far"))
    dag = renewed(dist.join(edges, dist["v"] == edges["src"]).join(ends, ["pivot", "dst"]).where("dist + w = far").select("pivot", F.col("v").alias("a"), F.col("dst").alias("b"), F.lit(1.0).alias("f")))
    edges.unpersist()
    sigma = _rounds(dist.where("dist = 0").select("pivot", "v", F.lit(1.0).alias("x")), dag)
    a, b = (sigma.select("pivot", F.col("v").alias(k), F.col("x").alias(f"s_{k}")) for k in ("a", "b"))
    back = renewed(dag.join(a, ["pivot", "a"]).join(b, ["pivot", "b"]).select("pivot", F.col("b").alias("a"), F.col("a").alias("b"), (F.col("s_a") / F.col("s_b")).alias("f")))
    ones = sigma.select("pivot", "v", F.lit(1.0).alias("x"))
    all_ = _rounds(ones, back)
    return all_.where("v <> pivot").groupBy(F.col("v").alias("id")).agg((F.sum("x") - F.count("*")).alias("value"))


def dependencies(graph: Graph, pivots: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(id, value): what the shortest paths from the pivots give to each vertex."""
    held = _Given(graph, s)
    found = held.by(pivots)
    held.close()
    return found


def betweenness(graph: Graph, s: Settings = Settings()) -> DataFrame:
    """(id, betweennessCentrality), over as many rounds of fresh pivots as the top set needs to settle, or over all vertices."""
    held = _Given(graph, s)
    batch = held.vertices if s.most is None and held.files is not None else s.batch
    used, total, before = 0, None, None
    while used < held.vertices and (s.most is None or used <= s.most):
        found = held.drawn(used, min(used + batch, held.vertices))
        used += batch
        total = found if total is None else total.unionByName(found)
        total = renewed(total.groupBy("id").agg(F.sum("value").alias("value")))
        if s.most is None:
            continue
        top = {r["id"] for r in total.orderBy(F.desc("value"), "id").limit(s.top).collect()}
        if before is not None and len(top - before) <= s.changes:
            break
        before = top
    held.close()
    base = graph.vertices.select("id")
    if total is None:
        return base.withColumn("betweennessCentrality", F.lit(0.0))
    return base.join(total, "id", "left").select("id", F.coalesce("value", F.lit(0.0)).alias("betweennessCentrality"))


def high_betweenness_set(graph: Graph, s: Settings = Settings()) -> DataFrame:
    """The vertices of the highest betweenness: value descending, then id. Values that only differ in how their sums were rounded are equal."""
    return betweenness(graph, s).orderBy(F.desc(F.round("betweennessCentrality", 6)), "id").limit(s.top)
