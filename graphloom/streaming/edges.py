"""Weights of edges kept up to date from a stream. Beyond what the batch engine needs.

Each micro-batch adds a table of its own sums, batch=N; now and then all of them become one, base=N, which holds everything up to
batch N. Tables count once they are whole, and a batch that runs again writes the same table again, so each edge counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import listed, removed


def _tables(spark: SparkSession, folder: str) -> tuple[int, list[int]]:
    """The newest whole base (-1: none) and the whole batches beyond it."""
    whole = [name for name in listed(spark, folder) if "=" in name and "_SUCCESS" in listed(spark, f"{folder}/{name}")]
    numbers = {kind: sorted(int(n.partition("=")[2]) for n in whole if n.startswith(f"{kind}=")) for kind in ("base", "batch")}
    base = max(numbers["base"], default=-1)
    return base, [n for n in numbers["batch"] if n > base]


def _summed(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.sum(F.col("weight").cast("long")).alias("weight"))


def add_batch(batch: DataFrame, number: int, folder: str, compact: int = 20) -> None:
    """Add the edges of micro-batch `number`; an error if one before it is missing, as then the sums would be short."""
    spark = batch.sparkSession
    base, batches = _tables(spark, folder)
    if number <= base:
        return
    expected = list(range(base + 1, number))
    if [n for n in batches if n != number] != expected:
        raise RuntimeError(f"{folder} holds the batches {batches} after {base}, and not those before {number}")
    _summed(batch.select("src", "dst", "weight")).write.mode("overwrite").parquet(f"{folder}/batch={number}")
    if number - base >= compact:
        current_edges(spark, folder).write.mode("overwrite").parquet(f"{folder}/base={number}")
        for name in listed(spark, folder):
            kind, _, n = name.partition("=")
            if kind == "batch" and int(n) <= number or kind == "base" and int(n) < number:
                removed(spark, f"{folder}/{name}")


def keep_edges(stream: DataFrame, folder: str, checkpoint: str, compact: int = 20, **trigger) -> StreamingQuery:
    """Add the edges (src, dst, weight) of each micro-batch to the tables in a folder of this stream's own; `current_edges` reads them."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: add_batch(batch, number, folder, compact))
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def current_edges(spark: SparkSession, folder: str) -> DataFrame:
    """(src, dst, weight) of all batches so far."""
    base, batches = _tables(spark, folder)
    paths = ([f"{folder}/base={base}"] if base >= 0 else []) + [f"{folder}/batch={n}" for n in batches]
    schema = "src long, dst long, weight long"
    if not paths:
        return spark.createDataFrame([], schema)
    frames = [spark.read.schema(schema).parquet(p) for p in paths]
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return _summed(out)
