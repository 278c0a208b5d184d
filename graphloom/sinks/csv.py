"""Graphs as two CSV files, of nodes and of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import blank, shown_date
from ..graph import Graph
from ..schemas import METRICS
from .text import save_sections

SEPARATOR = ";"


def _lines(df: DataFrame, columns: dict) -> list:
    # texts can't hold the separator or a line's end, as nothing is quoted
    clean = [F.translate(blank(c), ";\r\n", "   ") for c in columns.values()]
    return [[SEPARATOR.join(columns)], df.select(F.concat_ws(SEPARATOR, *clean).alias("value"))]


def node_columns(vertices: DataFrame) -> dict:
    shown = {"Id": F.col("id"), "Label": F.col("nickName") if "nickName" in vertices.columns else F.col("id")}
    shown |= {c: shown_date(F.col(c)) if c.endswith("Date") else F.col(c) for c in vertices.columns if c not in ("id", "nickName", "parentData", *METRICS)}
    return shown | {m: F.col(m) for m in METRICS if m in vertices.columns}


def edge_columns(edges: DataFrame) -> dict:
    first = {"Source": F.col("src"), "Target": F.col("dst"), "Type": F.lit("Directed"), "Id": F.col("edgeId"), "Weight": F.col("weight") if "weight" in edges.columns else F.lit(1)}
    if "lastItemBody" in edges.columns:
        first["Label"] = F.col("lastItemBody")
    return first | {c: shown_date(F.col(c)) if c.endswith("Date") else F.col(c) for c in edges.columns if c.startswith(("first", "last")) and c != "lastItemBody"}


def numbered(edges: DataFrame) -> DataFrame:
    """Edges with an id each, which is unique and needs no shuffle."""
    return edges.withColumn("edgeId", F.monotonically_increasing_id())


def save_csv(graph: Graph, target: str) -> tuple[str, str]:
    base = target.removesuffix(".csv")
    edges = numbered(graph.edges)
    return save_sections(_lines(graph.vertices, node_columns(graph.vertices)), f"{base}_nodes.csv"), save_sections(_lines(edges, edge_columns(graph.edges)), f"{base}_edges.csv")
