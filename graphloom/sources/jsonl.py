"""Graphs stored as JSON lines: vertices and edges in one file, told apart by `_type`."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..graph import Graph
from ..schemas import EDGE, METRICS, VERTEX

_NEEDED = ["id", "nickName", "activity", "rating", "firstItemDate", "lastItemDate", "urlNumber", "domainNumber"]


def read_jsonl(spark: SparkSession, path: str) -> Graph:
    """Rows that lack an id, a name, numbers or dates are left out; metrics are kept where any vertex has them, numbers or not."""
    fields = {f.name: f for f in [*VERTEX, *EDGE]} | {m.lower(): T.StructField(m.lower(), T.StringType()) for m in METRICS}
    rows = spark.read.schema(T.StructType([T.StructField("_type", T.StringType()), *fields.values()])).json(path)
    vertices = rows.where("_type = 'author'").dropna(subset=_NEEDED)
    have = vertices.agg(*(F.count(m.lower()).alias(m) for m in METRICS)).head()
    scores = [F.expr(f"try_cast({m.lower()} as {k.simpleString()})").alias(m) for m, k in METRICS.items() if have[m]]
    kept = [F.coalesce("parentData", F.lit(False)).alias("parentData") if f.name == "parentData" else F.col(f.name) for f in VERTEX]
    edges = rows.where("_type = 'edge'").dropna(subset=["src", "dst", "weight", "firstItemDate", "lastItemDate"]).select(*EDGE.fieldNames())
    return Graph(vertices.select(*kept, *scores), edges)
