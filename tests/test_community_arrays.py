"""Levels of communities as arrays and as rows."""

import pytest

from graphloom.operators import louvain, packed

from .test_communities import drawn, graph
from .test_packed import jobs


@pytest.mark.parametrize("impl", ["louvain", "compat"])
def test_arrays_in_many_files_like_rows(spark, monkeypatch, impl):
    monkeypatch.setattr(packed, "EDGES", 25)
    g = graph(spark, drawn(8, 30, 90), [99])
    one, two = ({r.id: r.modularity for r in louvain.communities(g, louvain.Settings(impl, held=n)).collect()} for n in (4_000_000, 0))
    assert one == two and len(set(one.values())) < 31


@pytest.mark.parametrize("impl", ["louvain", "compat"])
def test_a_pass_takes_one_job(spark, impl):
    g = graph(spark, drawn(9, 40, 120))
    passes = louvain._Passes.over
    calls = []
    louvain._Passes.over = lambda self, *a: calls.append(1) or passes(self, *a)
    try:
        _, n = jobs(spark, f"communities {impl}", lambda: louvain.communities(g, louvain.Settings(impl)).collect())
    finally:
        louvain._Passes.over = passes
    assert len(calls) > 4 and n < len(calls) + 150
