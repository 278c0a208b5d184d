"""Settings, whole jobs, and the command line."""

import json

import pytest

from graphloom import __main__ as command
from graphloom.plans import networks, server, stages
from graphloom.plans.config import ConfigError, NetworkConfig, parsed
from graphloom.plans.job import run
from graphloom.session import opened_session
from graphloom.sources import items as source
from graphloom.sources.gexf import read_gexf
from graphloom.sources.jsonl import read_jsonl

from .items import items

MINIMAL = """
network { # the least that a job needs
  type = AuthorNetwork
  connectionString = "host:9200;index/item;{\\"query\\": {}}"
  outputPath = /tmp/out
}
"""


def test_defaults(tmp_path):
    (tmp_path / "minimal.conf").write_text(MINIMAL)
    c = NetworkConfig.load(str(tmp_path / "minimal.conf"), environment={})
    assert (c.exporter, c.datasource, c.partition_strategy, c.type, c.eigen_iterations) == ("GephiExporter", "Elastic", "CanonicalRandomVertexCut", "AuthorNetwork", 100)
    assert c.connection.startswith("host:9200;index/item;{")


def test_layers_go_before_the_file(tmp_path):
    (tmp_path / "c.conf").write_text(MINIMAL + "\nnetwork.partition.strategy = EdgePartition1D\nnetwork.sampleSize: 7")
    c = NetworkConfig.load(str(tmp_path / "c.conf"), {"network.partition.strategy": "RandomVertexCut"}, {"network.sampleSize": "8", "other": "x"})
    assert (c.partition_strategy, c.sample_size) == ("RandomVertexCut", 8)


@pytest.mark.parametrize("more, what", [({"metrics": "DEGREE,NONSENSE"}, "NONSENSE"), ({"filter": {"a": {"name": "NONSENSE", "min": 1}}}, "NONSENSE"), ({"filter": {"a": {"name": "COMPONENT", "min": 1}}}, "COMPONENT"), ({"ego": "x"}, "ego"), ({"type": None}, "network.type"), ({"sampleData": "maybe"}, "sampleData")])
def test_bad_settings_are_errors(more, what):
    with pytest.raises(ConfigError, match=what):
        NetworkConfig.of({"network": {"type": "AuthorNetwork", "connectionString": "c", "outputPath": "o"} | more})


def test_lists_of_metrics_and_filters():
    c = NetworkConfig.of({"network": {"type": "AuthorNetwork", "connectionString": "c", "outputPath": "o", "metrics": "degree, all, DEGREE", "filter": {"b": {"name": "INDEGREE", "max": 3}, "a": {"name": "degree", "min": "1"}}}})
    assert c.metrics == ("DEGREE", "MODULARITY", "EIGENCENTRALITY", "WEIGHTEDDEGREE", "COMPONENT", "PAGERANK")
    assert [(f.column, f.low, f.high) for f in c.filters] == [("degree", 1.0, None), ("inDegree", None, 3.0)]


def test_text_like_hocon():
    assert parsed("a { b = [1, x y], c: \"q { # }\" } // end\na.d = /p/q:r") == {"a": {"b": ["1", "x y"], "c": "q { # }", "d": "/p/q:r"}}


@pytest.mark.parametrize("name", ["AuthorNetwork", "EgoNetwork"])
def test_services_by_name(name):
    assert type(networks.network(name)).__name__ == name
    assert networks.exporter(f"{name}GephiExporter") == networks.exporter("GephiExporter") == networks.exporter("gephi")
    assert networks.source(f"{name}JsonDataSource") == networks.source("Json")
    for find in (networks.network, networks.source, networks.exporter):
        with pytest.raises(ConfigError):
            find("Nothing")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("posts")
    items(spark).write.parquet(f"{folder}/items.parquet")
    return f"{folder}/items.parquet"


def job(stored, tmp_path, **more):
    return NetworkConfig.of({"network": {"type": "AuthorNetwork", "connectionString": stored, "outputPath": str(tmp_path / "out"), "datasource": "Items"} | more})


def test_a_whole_job(spark, stored, tmp_path):
    result = run(spark, job(stored, tmp_path, metrics="WEIGHTEDDEGREES,COMPONENT,PAGERANK", filter={"a": {"name": "INDEGREE", "min": 1}}, partition={"number": 3}))
    assert {r.id for r in result.graph.vertices.collect()} == {1, 2, 3}
    back = read_gexf(spark, result.graph_file)
    assert {r.id: (r.nickName, r.degree, r.component) for r in back.vertices.collect()} == {1: ("author1", 3, 1), 2: ("author2", 4, 1), 3: ("author3", 4, 1)}
    assert sorted((r.src, r.weight, r.dst) for r in back.edges.collect()) == [(1, 1, 2), (2, 1, 3), (2, 2, 1), (3, 1, 1), (3, 1, 2)]
    with open(result.stats_file) as f:
        lines = f.read().splitlines()
    assert lines[:2] == ["vertices: 3", "edges: 5"]
    assert any(x.startswith("degree: count=3, mean=3.66") and "max=4.0, min=3.0" in x for x in lines)
    assert "component clusters: 1" in lines and "component largest: 1=3" in lines and "degree top: 2=4 3=4 1=3" in lines
    assert "graph: " in result.summary() and "PAGERANK: " in result.summary()


def test_a_stored_graph_as_source(spark, stored, tmp_path):
    first = run(spark, job(stored, tmp_path, metrics="DEGREE", exporter="JsonExporter"))
    again = run(spark, job(first.graph_file, tmp_path / "2", datasource="JsonDataSource", metrics="COMPONENT", exporter="CsvExporter"))
    got = {r.id: (r.degree, r.component) for r in again.graph.vertices.collect()}
    assert got == {1: (3, 1), 2: (4, 1), 3: (4, 1), 4: (1, 1)}
    with open(str(tmp_path / "2" / "out" / "AuthorNetwork_nodes.csv")) as f:
        assert f.readline().startswith("Id;Label;") and len(f.readlines()) == 4


def test_people_without_dates_do_not_come_back(spark, tmp_path):
    """Who is only mentioned has no dates; a stored vertex needs them, and its edges stay."""
    result = run(spark, job_of(spark, tmp_path))
    assert {r.id for r in result.graph.vertices.collect()} == {1, 2, 3, 4}
    assert {r.id for r in read_jsonl(spark, result.graph_file).vertices.collect()} == {1, 2, 3}
    assert read_jsonl(spark, result.graph_file).edges.count() == result.graph.edges.count()


def job_of(spark, tmp_path):
    items(spark).where("item_id <= 7").write.parquet(str(tmp_path / "few.parquet"))
    return NetworkConfig.of({"network": {"type": "EgoNetwork", "connectionString": str(tmp_path / "few.parquet"), "outputPath": str(tmp_path / "out"), "datasource": "Items", "exporter": "JsonExporter"}})


def test_command_line(spark, stored, tmp_path, capsys):
    (tmp_path / "job.conf").write_text(f"network {{ type = AuthorNetwork, connectionString = {stored}, outputPath = {tmp_path}/cli, datasource = Items, metrics = DEGREE }}")
    assert command.main(["--conf", str(tmp_path / "job.conf"), "network.exporter=JsonExporter"]) == 0
    assert "export: " in capsys.readouterr().out
    with open(f"{tmp_path}/cli/AuthorNetwork.json") as f:
        assert {json.loads(x)["_type"] for x in f} == {"author", "edge"}


def test_as_a_server_calls_it(spark, stored, tmp_path):
    good = {"network": {"type": "AuthorNetwork", "connectionString": stored, "outputPath": str(tmp_path / "served"), "datasource": "Items", "metrics": "DEGREE"}}
    assert server.validate(good) == server.Valid()
    for more in ({"metrics": "NONSENSE"}, {"type": "Nothing"}, {"exporter": "Nothing"}, {"outputPath": ""}):
        bad = {"network": good["network"] | more}
        assert isinstance(server.validate(bad), server.Invalid) and server.validate(bad).reason
        with pytest.raises(ValueError):
            server.run_job(spark, bad)
    got = server.run_job(spark, good)
    assert read_gexf(spark, got["graph"]).vertices.count() == 4 and "export" in got["seconds"]


def test_stages_and_lineage(spark, stored, tmp_path):
    result = run(spark, job(stored, tmp_path, metrics="DEGREE"))
    assert "vertices: " in result.lineage() and "columns id, " in result.lineage()
    rows = stages.stage_rows(spark)
    frame = spark.createDataFrame(rows, stages.SCHEMA)
    assert frame.where("tasks > 0 and run_ms >= 0").count() == len(rows) > 3
    assert any(len(r[10]) == 5 and r[10] == sorted(r[10]) for r in rows)
    assert stages.stage_report(spark).startswith("stage ")


def test_a_session_that_is_there_stays(spark):
    with opened_session("x") as found:
        assert found is spark
    assert spark.range(3).count() == 3


def test_validation_comes_before_reading(spark, tmp_path):
    with pytest.raises(ConfigError):
        run(spark, job("/nowhere", tmp_path, exporter="Nothing"))


QUERY = '{"query": {"bool": {"should": [{"term": {"nick_id": 4}}, {"term": {"item_parentNickId": 4}}, {"term": {"lang": "a;b"}}]}}}'


def test_search_options():
    assert source.search_options(f"posts/item;{QUERY}") == ({"es.query": QUERY}, "posts/item")
    assert source.search_options(f"n1,n2;posts/item;{QUERY}") == ({"es.query": QUERY, "es.nodes": "n1,n2"}, "posts/item")
    assert source.search_options("posts/item;?q=a:b") == ({"es.query": "?q=a:b"}, "posts/item")
    for wrong in (QUERY, "a;b;c;{}", "a;"):
        with pytest.raises(ValueError):
            source.search_options(wrong)


def test_an_ego_is_searched_for_in_two_scans(spark, monkeypatch):
    asked = []

    def read(spark_, connection):
        asked.append(connection)
        found = json.loads(connection.split(";", 1)[1])["query"]["bool"]["should"]
        ids = found[0]["term"]["nick_id"] if "term" in found[0] else found[0]["terms"]["nick_id"]
        return items(spark_).where(f"nick_id in ({str(ids).strip('[]')}) or item_parentNickId in ({str(ids).strip('[]')})")

    monkeypatch.setattr(networks, "read_items", read)
    config = NetworkConfig("EgoNetwork", f"posts/item;{QUERY}", "-", ego=4, ego_relations=2)
    got = sorted(r.item_id for r in networks.network("EgoNetwork").items(spark, config).collect())
    assert asked[0] == config.connection and len(asked) == 2
    second = json.loads(asked[1].split(";", 1)[1])["query"]["bool"]["should"]
    people = second[0]["terms"]["nick_id"]
    assert second == [{"terms": {"nick_id": people}}, {"terms": {"item_parentNickId": people}}, {"term": {"lang": "a;b"}}] and len(people) == 2
    assert len(set(got)) == len(got) > 1
