import pytest
from pyspark.sql import functions as F

from graphloom.operators import betweenness as bc
from graphloom.operators import centrality, components, construction, degree, filters, louvain, metrics, pregel
from graphloom.plans.networks import AuthorNetwork, EgoNetwork

from .items import day, items


@pytest.fixture(scope="module")
def author(spark):
    g = AuthorNetwork().build(items(spark))
    return g.with_(vertices=g.vertices.persist(), edges=g.edges.persist())


def by_id(df, *columns):
    return {r["id"]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def test_edges(author):
    assert sorted((r.src, r.weight, r.dst) for r in author.edges.collect()) == [(1, 1, 2), (2, 1, 3), (2, 2, 1), (3, 1, 1), (3, 1, 2), (4, 1, 3)]


def test_vertices(author):
    got = by_id(author.vertices, "nickName", "urlNumber", "domainNumber", "firstItemDate", "lastItemDate")
    assert got[1] == ("author1", 3, 2, day(1), day(7)) and got[2][:3] == ("author2", 2, 1) and len(got) == 4


def test_degrees(author):
    want = {1: (3, 2, 1, 4, 3, 1), 2: (4, 2, 2, 5, 2, 3), 3: (4, 2, 2, 4, 2, 2), 4: (1, 0, 1, 1, 0, 1)}
    assert by_id(degree.degrees(author), "degree", "inDegree", "outDegree", "weightedDegree", "weightedInDegree", "weightedOutDegree") == want


def test_pagerank(author):
    want = {1: 1.1831366975198625, 2: 1.527782902438515, 3: 0.9268077335363691, 4: 0.15}
    assert by_id(centrality.pagerank(author), "pageRank") == pytest.approx(want, rel=1e-9)


def test_eigenvector(author):
    assert by_id(centrality.eigenvector(author), "eigenCentrality") == pytest.approx({1: 1.0, 2: 1.0, 3: 0.6187484941488304, 4: 0.0}, abs=1e-6)


@pytest.mark.parametrize("hub", [0, 1, 3])
def test_hubs_apart_give_the_same(author, hub):
    """Sources with more edges than `hub` are joined by another way."""
    one, two = (by_id(centrality.pagerank(author, hub=k), "pageRank") for k in (hub, 10**6))
    assert one == pytest.approx(two, rel=1e-12)
    one, two = (by_id(centrality.eigenvector(author, 5, hub=k), "eigenCentrality") for k in (hub, 10**6))
    assert one == pytest.approx(two, rel=1e-12)
    start = {"n": F.col("id"), "go": F.lit(True)}
    got = (pregel.pregel(author, start, F.col("n") * F.col("weight"), F.max, {"n": F.greatest("n", F.coalesce("msg", "n")), "go": F.coalesce("msg", F.lit(0)) > F.col("n")}, F.col("go"), 3, hub=k) for k in (hub, 10**6))
    one, two = (by_id(g, "n") for g in got)
    assert one == two and max(one.values()) > 4


def test_components_and_communities(author):
    assert by_id(components.components(author), "component") == dict.fromkeys([1, 2, 3, 4], 1)
    assert components.giant_component(author).vertices.count() == 4
    assert set(by_id(louvain.communities(author), "modularity")) == {1, 2, 3, 4}


def test_betweenness(author):
    assert by_id(bc.betweenness(author), "betweennessCentrality") == pytest.approx({1: 0, 2: 1, 3: 2.5, 4: 0})


@pytest.mark.parametrize("low, high, n", [(1, 3, 3), (-1, 1, 1)])
def test_range_filter(author, low, high, n):
    g = author.with_(vertices=author.vertices.join(degree.degrees(author), "id"))
    assert filters.filtered(g, [filters.RangeFilter("inDegree", low, high)]).vertices.count() == n


def test_ego_network(spark):
    got = construction.ego_expansion(items(spark), ego=4, k=25)
    assert {r.item_id for r in got.collect()} >= {4, 6, 8, 9}
    seeds = items(spark).where("item_id in (4, 6, 8, 9)")
    g = EgoNetwork().build(seeds)
    assert sorted((r.src, r.weight, r.dst) for r in g.edges.collect()) == [(2, 1, 3), (3, 1, 1), (3, 1, 2), (4, 1, 3)]
    assert g.vertices.count() == 4


def test_metrics_are_validated():
    with pytest.raises(ValueError):
        metrics.validate(["NONSENSE"], True, True)
