"""Graphs as GEXF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import escaped, pair, shown_date
from ..graph import Graph
from ..schemas import METRICS
from ..sources.gexf import VERTEX_ATTRIBUTES
from .text import save_sections

_EDGE_NAMES = ("LINKS", "FIRST PUBDATE", "LAST PUBDATE")


def _value(name: str, c: Column) -> Column:
    """An attribute element; nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f'<attvalue for="{name}" value="'), escaped(c.cast("string")), F.lit('"/>')), F.lit(""))


def _kind(kind: T.DataType) -> str:
    return {T.DoubleType: "double", T.LongType: "long", T.IntegerType: "integer"}.get(type(kind), "string")


def header(vertices: DataFrame, directed: bool, extra: dict[str, str] | None = None) -> list[str]:
    names = {n: "string" for n, c in VERTEX_ATTRIBUTES.items() if c in vertices.columns} | (extra or {})
    names |= {m.upper(): _kind(METRICS[m]) for m in METRICS if m in vertices.columns}
    lines = ['<?xml version="1.0" encoding="UTF-8"?>', '<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2">', f'<graph mode="static" defaultedgetype="{"directed" if directed else "undirected"}">', '<attributes class="node">']
    lines += [f'<attribute id="{n}" title="{n}" type="{k}"/>' for n, k in names.items()]
    lines += ["</attributes>", '<attributes class="edge">', *(f'<attribute id="{n}" title="{n}" type="string"/>' for n in _EDGE_NAMES), "</attributes>"]
    return lines


def node_lines(vertices: DataFrame) -> DataFrame:
    parts = []
    for name, column in VERTEX_ATTRIBUTES.items():
        if column in vertices.columns:
            c = F.col(column)
            parts.append(_value(name, shown_date(c) if column.endswith("Date") else c))
    if "nickId" in vertices.columns:
        parts.append(_value("NICKID", F.col("nickId")))
    parts += [_value(m.upper(), F.col(m)) for m in METRICS if m in vertices.columns]
    label = escaped(F.coalesce(F.col("nickName"), F.col("id").cast("string"))) if "nickName" in vertices.columns else F.col("id").cast("string")
    return vertices.select(F.concat(F.lit('<node id="'), F.col("id").cast("string"), F.lit('" label="'), label, F.lit('"><attvalues>'), *parts, F.lit("</attvalues></node>")).alias("value"))


def edge_lines(edges: DataFrame) -> DataFrame:
    have = set(edges.columns)
    weight = F.coalesce(F.col("weight"), F.lit(1)) if "weight" in have else F.lit(1)
    many = weight > 1

    def both(kind: str) -> Column:
        return escaped(pair(F.col(f"firstItem{kind}"), F.col(f"lastItem{kind}"), many)) if f"firstItem{kind}" in have else F.lit(None).cast("string")

    label = F.coalesce(F.concat(F.lit(' label="'), both("Body"), F.lit('"')), F.lit(""))
    shown = F.when(many, F.concat(F.lit(' weight="'), weight.cast("string"), F.lit('"'))).otherwise("")
    values = [F.coalesce(F.concat(F.lit('<attvalue for="LINKS" value="'), both("Link"), F.lit('"/>')), F.lit(""))]
    values += [_value(n, shown_date(F.col(c))) for n, c in (("FIRST PUBDATE", "firstItemDate"), ("LAST PUBDATE", "lastItemDate")) if c in have]
    return edges.select(F.concat(F.lit('<edge source="'), F.col("src").cast("string"), F.lit('" target="'), F.col("dst").cast("string"), F.lit('"'), label, shown, F.lit("><attvalues>"), *values, F.lit("</attvalues></edge>")).alias("value"))


def save_gexf(graph: Graph, target: str, extra: dict[str, str] | None = None) -> str:
    vertices = graph.vertices
    if "nickId" in vertices.columns:
        extra = {"NICKID": "long"} | (extra or {})
    return save_sections([[*header(vertices, graph.directed, extra), "<nodes>"], node_lines(vertices), ["</nodes>", "<edges>"], edge_lines(graph.edges), ["</edges>", "</graph>", "</gexf>"]], target)
