"""Graphs as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..schemas import METRICS
from .text import save_sections


def _rows(df: DataFrame, kind: str) -> DataFrame:
    columns = [F.col(c).alias(c.lower() if c in METRICS else c) for c in df.columns]
    return df.select(F.to_json(F.struct(F.lit(kind).alias("_type"), *columns)).alias("value"))


def save_jsonl(graph: Graph, target: str) -> str:
    """The kind of row first, nulls left out, metrics as numbers under their names in lower case."""
    return save_sections([_rows(graph.vertices, "author"), _rows(graph.edges, "edge")], target)
