"""Communities against plain Python versions of the same rules."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from graphloom.graph import Graph
from graphloom.operators import louvain


def graph(spark, edges, more=()):
    ids = sorted({x for a, b, _ in edges for x in (a, b)} | set(more))
    return Graph(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(edges, "src long, dst long, weight long"))


def cliques(sizes, bridge=1, weight=3):
    out, first = [], 1
    for n in sizes:
        out += [(first + a, first + b, weight) for a in range(n) for b in range(a)]
        if first > 1:
            out.append((first, first - 1, bridge))
        first += n
    return out


def drawn(seed, n, m, groups=3):
    rng = random.Random(seed)
    out = []
    for _ in range(m):
        a = rng.randrange(n)
        b = rng.choice([x for x in range(n) if x % groups == a % groups]) if rng.random() < 0.8 else rng.randrange(n)
        out.append((a, b, rng.randrange(1, 4)))
    return out


def compat(edges, ids, s):
    """Per vertex: its neighbours with the weight of all edges to them, a loop twice."""
    near = defaultdict(Counter)
    for a, b, w in edges:
        near[a][b] += w if s.use_weight else 1
        near[b][a] += w if s.use_weight else 1
    track, q = {i: i for i in ids}, -1.0
    while near:
        deg = {v: sum(n.values()) for v, n in near.items()}
        total, com = sum(deg.values()), {v: v for v in near}
        n, quiet, before, updates, applied = 0, 0, 0, -s.min_updates, False
        while True:
            size, new = Counter(com.values()), {}
            for v in near:
                best, to = 0.0, com[v]
                for u in sorted(near[v]):
                    if com[u] == com[v]:
                        gain = s.resolution * near[v][u] - float(np.float32(deg[v] * (deg[u] - deg[v]))) / (2 * total) if size[com[v]] > 1 else 0.0
                    else:
                        gain = s.resolution * near[v][u] - float(np.float32(deg[v] * deg[u])) / (2 * total)
                    if gain > best:
                        best, to = gain, com[u]
                new[v] = to if (to < com[v] if n % 2 == 0 else to > com[v]) else com[v]
            moved = sum(new[v] != com[v] for v in near)
            n += 1
            updates = moved + (0 if n % 2 else updates)
            if n % 2 == 0:
                quiet += updates >= before - s.min_updates
                before = updates
            if not (quiet <= 1 and updates > 0 and n < s.iterations):
                break
            com, applied = new, True
        if not applied:
            break
        track = {i: com.get(c, c) for i, c in track.items()}
        if n <= 2:
            break
        folded = {(max(com[v], com[u]), min(com[v], com[u]), w) for v in near for u, w in near[v].items()}
        near = defaultdict(Counter)
        for a, b, w in folded:
            near[a][b] += w
            near[b][a] += w
        deg = {v: sum(x.values()) for v, x in near.items()}
        total = sum(deg.values())
        now = sum(s.resolution * near[v][v] / total - (deg[v] / (2 * total)) ** 2 for v in near if v in near[v])
        if not now > q + s.increase:
            break
        q = now
    return track


def quality(pairs, com, s):
    k, inside = Counter(), Counter()
    for (a, b), w in pairs.items():
        k[com[a]] += w
        k[com[b]] += w
        if com[a] == com[b]:
            inside[com[a]] += 2 * w
    m2 = sum(k.values())
    return sum(s.resolution * inside[c] / m2 - (k[c] / m2) ** 2 for c in k)


def moves(edges, ids, s):
    """Labels, and the modularity after each level."""
    pairs = Counter()
    for a, b, w in edges:
        pairs[min(a, b), max(a, b)] += w if s.use_weight else 1
    track, last, curve = {i: i for i in ids}, None, []
    while pairs:
        k, near = Counter(), defaultdict(Counter)
        for (a, b), w in pairs.items():
            k[a] += w
            k[b] += w
            if a != b:
                near[a][b] += w
                near[b][a] += w
        m2, com = sum(k.values()), {v: v for v in k}
        if last is None:
            last = quality(pairs, com, s)
        quiet = n = 0
        while quiet < 2 and n < s.iterations:
            total, new = Counter(), {}
            for v in k:
                total[com[v]] += k[v]
            for v in k:
                to = Counter({com[v]: 0})
                for u, w in near[v].items():
                    to[com[u]] += w
                gain = {c: round(s.resolution * w - k[v] * (total[c] - (k[v] if c == com[v] else 0)) / m2, 9) for c, w in to.items()}
                best = max(gain, key=lambda c: (gain[c], c == com[v], c))
                new[v] = best if (best < com[v] if n % 2 == 0 else best > com[v]) else com[v]
            quiet = quiet + 1 if sum(new[v] != com[v] for v in k) < s.min_updates else 0
            com, n = new, n + 1
        now = quality(pairs, com, s)
        if now <= last + s.increase:
            break
        last = now
        curve.append(now)
        track = {i: com.get(c, c) for i, c in track.items()}
        folded = Counter()
        for (a, b), w in pairs.items():
            folded[min(com[a], com[b]), max(com[a], com[b])] += w
        pairs = folded
    return track, curve


LOOPS = [(1, 1, 4), (1, 2, 1), (2, 3, 1), (3, 1, 1), (3, 3, 2), (4, 5, 1), (5, 4, 1), (4, 5, 1)]
CASES = {
    "cliques": (cliques([4, 4, 5]), []), "loops, both directions, isolated": (LOOPS, [77, 78]), "ties": ([(a, (a + 1) % 8, 1) for a in range(8)], []),
    "drawn 1": (drawn(1, 24, 60), []), "drawn 2": (drawn(2, 30, 70, 5), [99]), "drawn 3": (drawn(3, 18, 80, 2), []),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("impl", ["louvain", "compat"])
def test_like_plain_python(spark, name, impl):
    edges, more = CASES[name]
    g, s = graph(spark, edges, more), louvain.Settings(impl)
    got = {r.id: r.modularity for r in louvain.communities(g, s).collect()}
    ids = [r.id for r in g.vertices.collect()]
    if impl == "compat":
        assert got == compat(edges, ids, s)
        return
    want, curve = moves(edges, ids, s)
    assert got == want and all(b > a for a, b in zip(curve, curve[1:]))
    found = louvain.modularity_score(g, spark.createDataFrame(list(got.items()), "id long, modularity long")).head().q
    assert found == pytest.approx(curve[-1] if curve else found)


@pytest.mark.parametrize("impl", ["louvain", "compat"])
def test_a_level_that_ends_at_the_pass_limit(spark, impl):
    edges = drawn(4, 30, 120)
    s = louvain.Settings(impl, iterations=3, use_weight=False, resolution=1.2)
    got = {r.id: r.modularity for r in louvain.communities(graph(spark, edges), s).collect()}
    assert got == (compat(edges, sorted(got), s) if impl == "compat" else moves(edges, sorted(got), s)[0])
    assert len(set(got.values())) < len(got)


def test_no_edges(spark):
    g = Graph(spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([], "src long, dst long, weight long"))
    for impl in ("louvain", "compat"):
        assert {tuple(r) for r in louvain.communities(g, louvain.Settings(impl)).collect()} == {(1, 1), (2, 2)}
    with pytest.raises(ValueError):
        louvain.communities(g, louvain.Settings("unknown"))
