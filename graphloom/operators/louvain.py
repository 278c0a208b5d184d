"""Communities by modularity.

`louvain` moves vertices by the gain over whole communities, with true modularity; `compat` looks at one neighbour at a time and keeps
the rules of an older implementation, over-merging included. Both keep the state as rows: vertices with their community, and links
(a, b, w) in both directions. A level ends when passes move too few vertices, or after `iterations` of them; levels go on as long as
each raises the modularity by more than `increase`.

Defined cases: vertices without edges are communities of their own; parallel edges and both directions add up; of options with equal
gains `louvain` stays, else takes the community of the larger id, `compat` takes the neighbour of the least id; a graph without
edges keeps each vertex alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..session import cut, observed, removed, renewed, scratch_path
from . import packed


@dataclass(frozen=True)
class Settings:
    impl: str = "louvain"
    use_weight: bool = True
    min_updates: int = 1
    resolution: float = 1.0
    increase: float = 0.001
    iterations: int = 30
    held: int = 4_000_000  # vertices of a level whose state is arrays, which tasks hold and the driver puts together; rows beyond it


def _undirected(graph: Graph, use_weight: bool) -> DataFrame:
    """(a, b, w), a <= b: weights between two vertices, both directions together."""
    w = graph.weights()
    weight = F.col("weight") if use_weight else F.lit(1).cast("long")
    return w.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum(weight).cast("double").alias("w"))


def modularity_score(graph: Graph, labels: DataFrame, use_weight: bool = True, resolution: float = 1.0) -> DataFrame:
    """One row, q: modularity of a labelling (id, modularity), edges taken without direction."""
    e = graph.weights().select("src", "dst", (F.col("weight") if use_weight else F.lit(1)).cast("double").alias("w"))
    sides = {s: labels.select(F.col("id").alias(s), F.col("modularity").alias(f"c_{s}")) for s in ("src", "dst")}
    both = e.join(sides["src"], "src").join(sides["dst"], "dst")
    inner = F.when(F.col("c_src") == F.col("c_dst"), F.col("w")).otherwise(0.0)
    ends = F.explode(F.array(F.struct(F.col("c_src").alias("c"), inner.alias("i")), F.struct(F.col("c_dst").alias("c"), F.lit(0.0).alias("i"))))
    by = both.select("w", ends.alias("e")).groupBy("e.c").agg(F.sum("w").alias("k"), F.sum("e.i").alias("inside"))
    total = by.agg(F.sum("k").alias("m2"))
    return by.crossJoin(F.broadcast(total)).agg(F.coalesce(F.sum(resolution * 2 * F.col("inside") / F.col("m2") - F.pow(F.col("k") / F.col("m2"), 2)), F.lit(0.0)).alias("q"))  # the total is one row


class _Passes:
    """Links (s, t, w) in files for the passes of a level: all links of a vertex lie in one file, vertices are numbered in the order of
    their ids. A pass is one job without a shuffle: tasks read the state of all vertices and give the new communities of theirs."""

    def __init__(self, links: DataFrame, ids: DataFrame):
        self.spark = links.sparkSession
        self.ids = packed.numbered(ids.select(F.col("id").alias("lot"), "id"))
        self.vertices = self.ids.count()
        sides = {e: self.ids.select(F.col("id").alias(e), F.col("n").alias(k)) for e, k in (("from", "s"), ("to", "t"))}
        coded = renewed(links.toDF("from", "to", "w").join(sides["from"], "from").join(sides["to"], "to").select("s", "t", "w"))
        self.files = packed.packed(coded, self.vertices, ("s",), coded.count())
        self.folder, self.n = scratch_path(self.spark, "passes"), 0

    def over(self, work: Callable, *state: np.ndarray) -> list:
        """What work(s, t, w, *state) gives for each file, with arrays by vertex of 8 bytes each."""
        files, vertices, now, kinds = self.files, self.vertices, f"{self.folder}/{self.n}", [a.dtype for a in state]
        self.n += 1
        packed.save(now, *state)

        def share(k: int):
            data = packed.kept(now, lambda: packed.load(now))
            return work(*files.read(k), *(np.frombuffer(data, d, vertices, 8 * vertices * i) for i, d in enumerate(kinds)))

        found = packed.over(self.spark, range(len(files.counts)), share)
        removed(self.spark, now)
        return found

    def state(self, communities: np.ndarray) -> DataFrame:
        """(v, c) of the vertices."""
        now = f"{self.folder}/state"
        packed.save(now, communities)
        numbers = self.spark.range(0, self.vertices, 1, max(1, -(-self.vertices // packed.EDGES))).select(F.col("id").alias("n"))
        found = numbers.mapInArrow(lambda batches: packed.looked_up(batches, packed.kept(now, lambda: np.frombuffer(packed.load(now), np.int64))), "n long, x long")
        of = self.ids.select(F.col("id").alias("c"), F.col("n").alias("x"))
        return renewed(found.join(self.ids, "n").join(of, "x").select(F.col("id").alias("v"), "c"))

    def close(self) -> None:
        removed(self.spark, self.folder)
        packed.dropped(self.spark, self.files)


def _last(groups: np.ndarray) -> np.ndarray:
    """Where a run of equal numbers ends."""
    return np.flatnonzero(np.append(groups[1:] != groups[:-1], True)) if len(groups) else np.zeros(0, np.int64)


class _Arrays:
    """A level as `_Level`, with its state in arrays."""

    def __init__(self, pairs: DataFrame, ids: DataFrame, s: Settings):
        self.s, self.pairs = s, pairs
        w = F.col("w").cast("long")
        both = F.explode(F.array(F.struct(F.col("a").alias("f"), F.col("b").alias("t"), w.alias("w")), F.struct(F.col("b").alias("f"), F.col("a").alias("t"), w.alias("w"))))
        # a loop counts at both of its ends; here too it is there twice
        self.passes = _Passes(pairs.select(both.alias("x")).select("x.*").groupBy("f", "t").agg(F.sum("w").alias("w")), ids)
        self.c = np.arange(self.passes.vertices)
        self.k = np.zeros(self.passes.vertices)
        for low, k in self.passes.over(_degrees):
            self.k[low : low + len(k)] += k
        self.m2 = float(self.k.sum())

    def quality(self) -> float:
        inner = sum(self.passes.over(lambda s, t, w, c: int(w[c[s] == c[t]].sum()), self.c))
        return self.s.resolution * inner / self.m2 - float(((np.bincount(self.c, self.k) / self.m2) ** 2).sum())

    def move(self, even: bool) -> int:
        resolution, m2 = self.s.resolution, self.m2

        def best(s, t, w, c, k, total):
            apart = s != t
            s, w, to = s[apart].astype(np.int64), w[apart].astype(float), c[t[apart]]
            own = np.unique(s)
            s, to, w = np.concatenate([s, own]), np.concatenate([to, c[own]]), np.concatenate([w, np.zeros(len(own))])
            order = np.lexsort((to, s))
            s, to, w = s[order], to[order], w[order]
            last = np.flatnonzero(np.append((s[1:] != s[:-1]) | (to[1:] != to[:-1]), True)) if len(s) else np.zeros(0, np.int64)
            w = np.diff(np.cumsum(w)[last], prepend=0.0)
            s, to = s[last], to[last]
            stays = to == c[s]
            gain = np.round(resolution * w - k[s] * (total[to] - np.where(stays, k[s], 0.0)) / m2, 9)
            order = np.lexsort((to, stays, gain, s))
            last = order[_last(s[order])]
            v, to = s[last], to[last]
            goes = to < c[v] if even else to > c[v]
            return v[goes], to[goes]

        new, moved = self.c.copy(), 0
        for v, to in self.passes.over(best, self.c, self.k, np.bincount(self.c, self.k, len(self.c))):
            new[v] = to
            moved += len(v)
        self.c = new
        return moved

    def close(self) -> DataFrame:
        """The state (v, c), when there are no more passes."""
        found = self.passes.state(self.c)
        self.passes.close()
        return found


def _degrees(s: np.ndarray, t: np.ndarray, w: np.ndarray) -> tuple[int, np.ndarray]:
    return int(s[0]), np.bincount(s - s[0], w)


class _Level:
    """One level: vertices (v, c, k) with weighted degree k, and links between different vertices in both directions."""

    def __init__(self, pairs: DataFrame, s: Settings):
        self.s = s
        self.pairs = pairs
        self.links = cut(pairs.where("a <> b").select(F.explode(F.array(F.struct("a", "b", "w"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "w"))).alias("x")).select("x.*").repartition("a"))
        ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("v"), "w"), F.struct(F.col("b").alias("v"), "w"))).alias("x")).select("x.*")
        self.state = renewed(ends.groupBy("v").agg(F.sum("w").alias("k")).withColumn("c", F.col("v")))
        self.m2 = float(self.state.agg(F.sum("k").alias("m")).head()["m"] or 0.0)

    def quality(self) -> float:
        side = self.state.select("v", "c")
        inner = self.pairs.join(side.withColumnsRenamed({"v": "a", "c": "ca"}), "a").join(side.withColumnsRenamed({"v": "b", "c": "cb"}), "b").where("ca = cb").groupBy(F.col("ca").alias("c")).agg(F.sum(2 * F.col("w")).alias("i"))
        by = self.state.groupBy("c").agg(F.sum("k").alias("k")).join(inner, "c", "left")
        return float(by.agg(F.sum(self.s.resolution * F.coalesce("i", F.lit(0.0)) / self.m2 - F.pow(F.col("k") / self.m2, 2)).alias("q")).head()["q"] or 0.0)

    def move(self, even: bool) -> int:
        """One pass: every vertex goes to the community of the highest gain, the larger id among equals; in even passes only to
        lower ids, in odd ones only to higher."""
        size = self.state.groupBy("c").agg(F.sum("k").alias("total"))
        near = self.links.join(self.state.select(F.col("v").alias("b"), F.col("c").alias("to")), "b").groupBy(F.col("a").alias("v"), "to").agg(F.sum("w").alias("w"))
        own = self.state.select("v", F.col("c").alias("to"), F.lit(0.0).alias("w"))
        options = near.unionByName(own).groupBy("v", "to").agg(F.sum("w").alias("w")).join(size.withColumnRenamed("c", "to"), "to").join(self.state, "v")
        rest = F.col("total") - F.when(F.col("to") == F.col("c"), F.col("k")).otherwise(0.0)
        gain = self.s.resolution * F.col("w") - F.col("k") * rest / self.m2
        best = options.groupBy("v", "k", "c").agg(F.max(F.struct(F.round(gain, 9).alias("g"), (F.col("to") == F.col("c")).alias("stays"), F.col("to"))).alias("b"))
        allowed = F.col("b.to") < F.col("c") if even else F.col("b.to") > F.col("c")
        new, seen = observed(best.select("v", "k", F.when(allowed, F.col("b.to")).otherwise(F.col("c")).alias("c"), allowed.alias("moved")), {"moved": F.count_if("moved")})
        self.state = new.drop("moved")
        return seen["moved"]

    def close(self) -> DataFrame:
        return self.state.select("v", "c")


def _level(pairs: DataFrame, s: Settings) -> _Level | _Arrays:
    ids = renewed(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    return _Arrays(pairs, ids, s) if 0 < ids.count() <= s.held else _Level(pairs, s)


def _folded(pairs: DataFrame, side: DataFrame) -> DataFrame:
    """The pairs of the next level: communities as vertices, inner weights as loops."""
    return pairs.join(side.withColumnsRenamed({"v": "a", "c": "ca"}), "a").join(side.withColumnsRenamed({"v": "b", "c": "cb"}), "b").groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("w").alias("w"))


def _louvain(graph: Graph, s: Settings) -> DataFrame:
    pairs = renewed(_undirected(graph, s.use_weight))
    track, last = None, None
    while True:
        level = _level(pairs, s)
        if not level.m2:
            level.close()
            break
        if last is None:
            last = level.quality()
        quiet, n = 0, 0
        while quiet < 2 and n < s.iterations:  # an even and an odd pass with too few moves
            quiet = quiet + 1 if level.move(n % 2 == 0) < s.min_updates else 0
            n += 1
        now = level.quality()
        state = level.close()
        if now <= last + s.increase:
            break
        last = now
        track = _relabelled(track, state)
        pairs = renewed(_folded(pairs, state))
    return track if track is not None else graph.vertices.select("id", F.col("id").alias("community"))


def _relabelled(track: DataFrame | None, state: DataFrame) -> DataFrame:
    if track is None:
        return renewed(state.select(F.col("v").alias("id"), F.col("c").alias("community")))
    return renewed(track.join(state.select(F.col("v").alias("community"), "c"), "community").select("id", F.col("c").alias("community")))


def _both_ends(edges: DataFrame) -> DataFrame:
    """(v, u, w) for both ends of the edges (v, u, w)."""
    return edges.select(F.explode(F.array(F.struct("v", "u", "w"), F.struct(F.col("u").alias("v"), F.col("v").alias("u"), "w"))).alias("x")).select("x.*")


class _Near:
    """A level whose vertices look at one neighbour at a time: (v, c, deg), and links to each neighbour. What a pass found is only taken
    over by `apply`."""

    def __init__(self, links: DataFrame, s: Settings):
        self.links, self.s = links, s
        self.state, seen = observed(links.groupBy("v").agg(F.sum("w").alias("deg")).withColumn("c", F.col("v")), {"total": F.coalesce(F.sum("deg"), F.lit(0))})
        self.total, self.found = float(seen["total"]), self.state

    def move(self, even: bool) -> int:
        s, total, state = self.s, self.total, self.state
        size = state.groupBy("c").agg(F.count("*").alias("size"))
        near = self.links.join(state.select(F.col("v").alias("u"), F.col("c").alias("to"), F.col("deg").alias("far")), "u").join(state.join(size, "c"), "v")
        push: Column = s.resolution * F.col("w") - (F.col("deg") * F.col("far")).cast("float") / (2 * total)
        same = s.resolution * F.col("w") - (F.col("deg") * (F.col("far") - F.col("deg"))).cast("float") / (2 * total)
        gain = F.when(F.col("to") != F.col("c"), push).when(F.col("size") > 1, same).otherwise(0.0)
        best = near.groupBy("v", "deg", "c").agg(F.max_by(F.struct("to"), F.struct(gain, -F.col("u"))).alias("b"), F.max(gain).alias("g"))
        gate = F.col("b.to") < F.col("c") if even else F.col("b.to") > F.col("c")
        goes = (F.col("g") > 0) & gate
        new, seen = observed(best.select("v", "deg", F.when(goes, F.col("b.to")).otherwise(F.col("c")).alias("c"), goes.alias("moved")), {"moved": F.count_if("moved")})
        self.found = new.drop("moved")
        return seen["moved"]

    def apply(self) -> None:
        self.state = self.found

    def close(self) -> DataFrame:
        return self.state.select("v", "c")


class _NearArrays:
    """A level as `_Near`, with its state in arrays."""

    def __init__(self, links: DataFrame, ids: DataFrame, s: Settings):
        self.s, self.passes = s, _Passes(links.select("v", "u", "w"), ids)
        self.c = self.found = np.arange(self.passes.vertices)
        self.deg = np.zeros(self.passes.vertices, np.int64)
        for low, deg in self.passes.over(_whole_degrees):
            self.deg[low : low + len(deg)] += deg
        self.total = float(self.deg.sum())

    def move(self, even: bool) -> int:
        resolution, total = self.s.resolution, self.total

        def best(s, t, w, c, deg, size):
            to, own, far = c[t], c[s], deg[t]
            less = np.where(to != own, far, far - deg[s])
            gain = resolution * w - (deg[s] * less).astype(np.float32).astype(float) / (2 * total)
            gain = np.where((to == own) & (size[own] < 2), 0.0, gain)
            order = np.lexsort((-t, gain, s))
            last = order[_last(s[order])]
            v, to, own = s[last], to[last], own[last]
            goes = (gain[last] > 0) & (to < own if even else to > own)
            return v[goes], to[goes]

        self.found, moved = self.c.copy(), 0
        for v, to in self.passes.over(best, self.c, self.deg, np.bincount(self.c, minlength=len(self.c))):
            self.found[v] = to
            moved += len(v)
        return moved

    def apply(self) -> None:
        self.c = self.found

    def close(self) -> DataFrame:
        found = self.passes.state(self.c)
        self.passes.close()
        return found


def _whole_degrees(s: np.ndarray, t: np.ndarray, w: np.ndarray) -> tuple[int, np.ndarray]:
    deg = np.zeros(int(s[-1] - s[0]) + 1, np.int64)
    np.add.at(deg, s - s[0], w)
    return int(s[0]), deg


def _compat(graph: Graph, s: Settings) -> DataFrame:
    """Neighbour by neighbour. The state of a level is (v, c, deg): deg is the weight of all edge ends of the vertex; links are the
    weights to each neighbour, loops counted twice. What the last pass of a level would have moved stays where it is."""
    edges = graph.weights().select(F.col("src").alias("v"), F.col("dst").alias("u"), F.col("weight").alias("w") if s.use_weight else F.lit(1).cast("long").alias("w"))
    track, q = None, -1.0
    links = renewed(_both_ends(edges).groupBy("v", "u").agg(F.sum("w").alias("w")))
    while True:
        ids = renewed(links.select(F.col("v").alias("id")).distinct())
        level = _NearArrays(links, ids, s) if 0 < ids.count() <= s.held else _Near(links, s)
        if not level.total:
            level.close()
            break
        n, quiet, before, updates, applied = 0, 0, 0, -s.min_updates, False
        while True:
            moved = level.move(n % 2 == 0)
            n += 1
            if n % 2:
                updates = 0
            updates += moved
            if n % 2 == 0:
                quiet += updates >= before - s.min_updates
                before = updates
            if not (quiet <= 1 and updates > 0 and n < s.iterations):
                break
            applied = True
            level.apply()
        side = level.close()
        if applied:
            track = _relabelled(track, side)
        if not applied or n <= 2:
            break
        pairs = links.join(side, "v").join(side.withColumnsRenamed({"v": "u", "c": "d"}), "u")
        # communities as vertices; of parallel edges with equal weights one is kept
        folded = pairs.select(F.greatest("c", "d").alias("v"), F.least("c", "d").alias("u"), "w").distinct().groupBy("v", "u").agg(F.sum("w").alias("w"))
        links = renewed(_both_ends(folded).groupBy("v", "u").agg(F.sum("w").alias("w")))
        # a loop's weight is in `links` twice already
        by = links.groupBy(F.col("v").alias("c")).agg(F.sum("w").alias("k"), F.sum(F.when(F.col("u") == F.col("v"), F.col("w"))).alias("i"))
        by = by.crossJoin(F.broadcast(by.agg(F.sum("k").alias("t"))))  # one row
        now = float(by.where("i is not null").agg(F.sum(s.resolution * F.col("i") / F.col("t") - F.pow(F.col("k") / (2 * F.col("t")), 2)).alias("q")).head()["q"] or 0.0)
        if not now > q + s.increase:
            break
        q = now
    return track if track is not None else graph.vertices.select("id", F.col("id").alias("community"))


def communities(graph: Graph, s: Settings = Settings()) -> DataFrame:
    """(id, modularity): a community for every vertex; those without edges are alone."""
    if s.impl not in ("louvain", "compat"):
        raise ValueError(f"unknown implementation of modularity: {s.impl}")
    found = (_louvain if s.impl == "louvain" else _compat)(graph, s)
    return graph.vertices.select("id").join(found, "id", "left").select("id", F.coalesce("community", "id").alias("modularity"))
