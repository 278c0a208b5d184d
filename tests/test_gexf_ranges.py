"""A GEXF file is read in ranges, each by a task of its own."""

import pytest

from graphloom.sources import gexf

NODE = '<node id="{k}" label="a{k}>b/&lt;é"><attvalues><attvalue for="NAME" value="n{k} /> x"/>\n<attvalue for="DEGREE" value="{k}"/></attvalues></node>'
MORE = ['<node id="1001" label="alone"/>', "<node\n id='1002'\tlabel='x'\n></node>", '<node id="1003"><attvalues></attvalues></node >', '<nodes/>']
EDGE = '<edge id="e{k}" source="{k}" target="{k}1" label="p||q" weight="{k}"><attvalues><attvalue for="LINKS" value="u||v"/></attvalues></edge>'


def text(separator, extra=()):
    nodes = [NODE.format(k=k) for k in range(1, 41)] + [*MORE, *extra]
    edges = [EDGE.format(k=k) for k in range(1, 41)] + ['<edge source="7" target="8"/>', '<edge source="7"/>']
    return separator.join(['<?xml version="1.0"?><gexf><graph>', "<nodes>", *nodes, "</nodes>", "<edges>", *edges, "</edges></graph></gexf>"])


def rows(g):
    return sorted(map(repr, g.vertices.collect())), sorted(map(repr, g.edges.collect()))


@pytest.mark.parametrize("separator", ["\n", "", "\r\n  "])
def test_ranges_give_the_same_as_the_whole(spark, tmp_path, monkeypatch, separator):
    path = str(tmp_path / "g.gexf")
    (tmp_path / "g.gexf").write_bytes(text(separator).encode())
    found = [rows(gexf.read_gexf(spark, path, split)) for split in (97, 1000, 1 << 20)]
    monkeypatch.setattr(gexf, "_hides_tags", lambda *_: True)
    want = rows(gexf.read_gexf(spark, path))
    assert found == [want] * 3 and (len(want[0]), len(want[1])) == (43, 41)


def test_a_file_has_more_than_one_task(spark, tmp_path):
    (tmp_path / "g.gexf").write_bytes(text("\n").encode())
    g = gexf.read_gexf(spark, str(tmp_path / "g.gexf"), 1000)
    assert g.edges.rdd.getNumPartitions() > 5 and g.vertices.rdd.getNumPartitions() > 5


@pytest.mark.parametrize("hidden", ['<!-- <node id="5000"/> -->', '<![CDATA[<node id="5000"/>]]>'])
def test_tags_that_are_no_elements(spark, tmp_path, hidden):
    (tmp_path / "g.gexf").write_bytes(text("\n", [hidden]).encode())
    assert {r.id for r in gexf.read_gexf(spark, str(tmp_path / "g.gexf"), 97).vertices.collect()} == {*range(1, 41), 1001, 1002, 1003}


def test_elements_that_are_malformed_are_left_out(spark, tmp_path):
    more = ['<node id="no number"/>', '<node id="2001" label="a & b"/>', '<node id="2002" label="in">']
    (tmp_path / "g.gexf").write_bytes(text("\n", more).replace("</edges>", '<edge source="9" target="8" weight="1.5"/></edges>').encode())
    g = gexf.read_gexf(spark, str(tmp_path / "g.gexf"), 500)
    assert {r.id for r in g.vertices.collect()} == {*range(1, 41), 1001, 1002, 1003} and g.edges.count() == 41
