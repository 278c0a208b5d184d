"""Operators over flat arrays: results against plain Python, the other way for large graphs, and rounds that cost no job each."""

import heapq
import random
from collections import defaultdict

import numpy as np
import pytest

from graphloom.graph import Graph
from graphloom.operators import betweenness as bc
from graphloom.operators import centrality, packed


def graph(spark, edges, more=(), less=()):
    ids = sorted({x for e in edges for x in e[:2]} | set(more) - set(less))
    return Graph(spark.createDataFrame([(i,) for i in ids if i not in less], "id long"), spark.createDataFrame(edges, "src long, dst long, weight long"))


def by_id(df, column):
    return {r["id"]: r[column] for r in df.collect()}


def jobs(spark, name, work):
    spark.sparkContext.setJobGroup(name, name)
    try:
        return work(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def brandes(edges, pivots):
    near, out = defaultdict(dict), defaultdict(float)
    for a, b, w in edges:
        if a != b:
            near[a][b] = min(near[a].get(b, 1 << 60), w or 1)
    for p in pivots:
        dist, sigma, before, order, heap = {p: 0}, defaultdict(float, {p: 1.0}), defaultdict(list), [], [(0, p)]
        while heap:
            d, v = heapq.heappop(heap)
            if v in order:
                continue
            order.append(v)
            for u, w in near[v].items():
                if d + w < dist.get(u, 1 << 60):
                    dist[u], sigma[u], before[u] = d + w, 0.0, []
                    heapq.heappush(heap, (d + w, u))
                if d + w == dist[u]:
                    sigma[u] += sigma[v]
                    before[u].append(v)
        delta = defaultdict(float)
        for v in reversed(order):
            for u in before[v]:
                delta[u] += sigma[u] / sigma[v] * (1 + delta[v])
            if v != p:
                out[v] += delta[v]
    return out


def drawn(seed, n, m):
    rng = random.Random(seed)
    return [(7 * rng.randrange(n), 7 * rng.randrange(n), rng.randrange(5)) for _ in range(m)]


def test_betweenness_like_plain_python(spark):
    """Loops, parallel edges, weights of 0, a vertex alone, ends that are no vertices."""
    edges = drawn(3, 25, 90)
    g = graph(spark, edges, [9999], [7])
    pivots = [r.id for r in g.vertices.collect()]
    want = brandes(edges, pivots)
    assert by_id(bc.betweenness(g, bc.EXACT), "betweennessCentrality") == pytest.approx({p: want[p] for p in pivots}, abs=1e-9)
    some = g.vertices.where("id in (14, 21, 9999)")
    found = by_id(bc.dependencies(g, some), "value")
    assert {k: v for k, v in found.items() if v} == pytest.approx({k: v for k, v in brandes(edges, [14, 21]).items() if v})
    assert found == pytest.approx(by_id(bc.dependencies(g, some, bc.Settings(held=0)), "value"))


@pytest.mark.parametrize("visits, slots", [(1, 1), (7, 100), (1 << 21, 1 << 20)])
def test_edges_in_small_bites(monkeypatch, visits, slots):
    monkeypatch.setattr(bc, "VISITS", visits)
    monkeypatch.setattr(bc, "SLOTS", slots)
    edges, n = [(a // 7, b // 7, w) for a, b, w in drawn(4, 25, 90)], 25
    least = {}
    for a, b, w in edges:
        if a != b:
            least[a, b] = min(least.get((a, b), 9), w or 1)
    s, t, w = (np.array(c) for c in zip(*((a, b, w) for (a, b), w in sorted(least.items()))))
    paths = bc._Paths(packed.Rows(np.searchsorted(s, np.arange(n + 1)), t.astype(np.int32), w), None)
    for at in range(0, n, paths.at_once):
        paths.add(np.arange(at, min(n, at + paths.at_once)))
    want = brandes(edges, range(n))
    assert paths.given.tolist() == pytest.approx([want[v] for v in range(n)], abs=1e-9)


def test_long_paths_take_no_job_a_step(spark):
    g = graph(spark, [(k, k + 1, 1 + k % 3) for k in range(150)])
    found, n = jobs(spark, "paths", lambda: by_id(bc.betweenness(g, bc.EXACT), "betweennessCentrality"))
    assert found == {k: float(k * (150 - k)) for k in range(151)} and n < 60
    with pytest.raises(Exception, match="more than 20 edges"):
        bc.betweenness(g, bc.Settings(supersteps=20))


def test_highest_of_equal_values(spark, monkeypatch):
    """Sums in another order differ in their last digits; of equal values the least ids are taken."""
    monkeypatch.setattr(bc, "betweenness", lambda g, s: spark.createDataFrame([(3, 0.1 + 0.2), (2, 0.3), (1, 0.2)], "id long, betweennessCentrality double"))
    assert [r.id for r in bc.high_betweenness_set(None, bc.Settings(top=1)).collect()] == [2]


@pytest.mark.parametrize("directed", [True, False])
def test_eigenvector_like_its_rows(spark, monkeypatch, directed):
    """Arrays in several files, rows with and without hubs, plain Python."""
    monkeypatch.setattr(packed, "EDGES", 40)
    edges = drawn(6, 30, 120)
    g = graph(spark, edges, [9999])
    both = edges + [(b, a, w) for a, b, w in edges] * (not directed)
    sums = {v: 0.0 for e in edges for v in e[:2]}
    hold = dict.fromkeys(sums, 1.0)
    for _ in range(4):
        for a, b, _ in both:
            sums[b] += hold[a]
        hold = {v: x / max(sums.values()) for v, x in sums.items()}
    want = pytest.approx(hold | {9999: 0.0})
    assert by_id(centrality.eigenvector(g, 4, directed), "eigenCentrality") == want
    for hub in (2, 10**6):
        assert by_id(centrality.eigenvector(g, 4, directed, hub, held=0), "eigenCentrality") == want


def test_a_round_of_powers_takes_one_small_job(spark):
    g = graph(spark, drawn(7, 20, 60))
    few, more = (jobs(spark, f"powers{n}", lambda n=n: centrality.eigenvector(g, n).collect())[1] for n in (2, 12))
    assert more - few <= 10


def test_eigenvector_of_no_edges(spark):
    g = Graph(spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([], "src long, dst long, weight long"))
    assert by_id(centrality.eigenvector(g), "eigenCentrality") == {1: 0.0, 2: 0.0}
