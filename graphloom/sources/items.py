"""Documents as input: parquet or JSON files, or Elasticsearch where its connector is on the class path."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ITEMS


SEARCH = "org.elasticsearch.spark.sql"


def search_options(connection: str) -> tuple[dict[str, str], str]:
    """Reader options and the index of [nodes;]index/type;query; the query may hold semicolons inside its braces."""
    head, brace, rest = connection.partition("{")
    parts = head.split(";")
    query = parts.pop() + brace + rest
    if not 1 <= len(parts) <= 2 or not query:
        raise ValueError(f"not [nodes;]index;query: {connection}")
    return {"es.query": query} | ({"es.nodes": parts[0]} if len(parts) == 2 else {}), parts[-1]


def with_schema(df: DataFrame) -> DataFrame:
    """The columns of ITEMS, null where a table lacks one; other columns go."""
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in ITEMS))


def read_items(spark: SparkSession, connection: str) -> DataFrame:
    """`connection`: a path of parquet or JSON files, or for Elasticsearch [nodes;]index/type;query."""
    if ";" in connection:
        options, index = search_options(connection)
        return with_schema(spark.read.format(SEARCH).options(**options).schema(ITEMS).load(index))
    if connection.rstrip("/").endswith((".json", ".jsonl")):
        return spark.read.schema(ITEMS).json(connection)
    return with_schema(spark.read.parquet(connection))


def sampled(items: DataFrame, size: int, seed: int | None = None) -> DataFrame:
    """Exactly `size` documents, if there are so many; with a seed a random choice that is the same each time."""
    if seed is None:
        return items.limit(size)
    return items.orderBy(F.xxhash64(F.lit(seed), "item_id"), "item_id").limit(size)


def expanded(connection: str, ids: list[int]) -> str:
    """The same connection with a query for several authors."""
    options, index = search_options(connection)
    return ";".join([*([options["es.nodes"]] if "es.nodes" in options else []), index, ego_query(options["es.query"], ids)])


def ego_query(query: str, ids: list[int]) -> str:
    """A term query on an author's id as one on several, for the two-step scan of Elasticsearch."""

    def changed(node):
        if isinstance(node, list):
            return [changed(x) for x in node]
        if not isinstance(node, dict):
            return node
        return {("terms" if k == "term" and set(v) & {"nick_id", "item_parentNickId"} else k): ({n: ids for n in v} if k == "term" and set(v) & {"nick_id", "item_parentNickId"} else changed(v)) for k, v in node.items()}

    return json.dumps(changed(json.loads(query)))
