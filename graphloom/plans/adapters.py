"""Graphs and documents made from the tables of orders and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..graph import Graph
from ..operators.construction import merged_edges
from ..schemas import ITEMS
from ..session import cut

_SHIFT = 1_000_000_000
#: Events of a range that one task goes through.
_RANGE = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(df: DataFrame, column: str) -> Column:
    """Epoch milliseconds; a time without a zone counts as UTC, whatever the session's zone is."""
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        return F.unix_millis(F.from_utc_timestamp(F.col(column).cast("timestamp"), F.current_timezone()))
    return F.unix_millis(column)


def trade_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge for each line of an order: customer to supplier, dated by the shipment."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_returnflag", "l_linestatus")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    both = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    return both.select(
        F.col("o_custkey").alias("src"), (F.col("l_suppkey") + _SHIFT).alias("dst"), F.lit(1).cast("long").alias("weight"),
        F.col("l_returnflag").alias("body"), F.col("l_linestatus").alias("link"), millis(lines, "l_shipdate").alias("date"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("order"),
    )


def trade(spark: SparkSession, sf_dir: str) -> Graph:
    """Its edges are merged once, though a query uses them for vertices and metrics too."""
    return Graph.of_edges(cut(merged_edges(trade_rows(spark, sf_dir))))


def event_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the one before it. Ranges of the order of all events are gone through side by side, so that no task sees all events;
    the first event of a range takes the last one of the range before."""
    events = table(spark, sf_dir, "events")
    e = events.select("event_id", "ts", millis(events, "ts").alias("ms"), "user_id", "event_type")
    parts = max(1, -(-events.count() // _RANGE))
    placed = cut(e.repartitionByRange(parts, "ts", "event_id").withColumn("_part", F.spark_partition_id())).repartition(parts, "_part")
    kept = F.struct(F.col("event_id").alias("p_event"), F.col("user_id").alias("p_user"), F.col("ms").alias("p_ms"))
    last = placed.groupBy("_part").agg(F.max_by(kept, F.struct("ts", "event_id")).alias("_last"))
    # a row for each range
    carried = last.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_carried"))
    within = F.lag(kept).over(Window.partitionBy("_part").orderBy("ts", "event_id"))
    pairs = placed.withColumn("_before", within).join(F.broadcast(carried), "_part").withColumn("_before", F.coalesce("_before", "_carried"))
    return pairs.select("event_id", "ts", "ms", "user_id", "event_type", *(F.col(f"_before.{c}").alias(c) for c in ("p_event", "p_user", "p_ms")))


def flow(spark: SparkSession, sf_dir: str) -> Graph:
    """User to the user of the next event; weight counts how often."""
    p = event_pairs(spark, sf_dir).where("p_event is not null")
    return Graph.of_edges(p.groupBy(F.col("p_user").alias("src"), F.col("user_id").alias("dst")).agg(F.count("*").alias("weight")))


def geography(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers and suppliers to their nations, nations to their regions: a graph with a component for each region."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("src"), (F.col("c_nationkey").cast("long") + 2 * _SHIFT).alias("dst"))
    suppliers = table(spark, sf_dir, "supplier").select((F.col("s_suppkey").cast("long") + _SHIFT).alias("src"), (F.col("s_nationkey").cast("long") + 2 * _SHIFT).alias("dst"))
    nations = table(spark, sf_dir, "nation").select((F.col("n_nationkey").cast("long") + 2 * _SHIFT).alias("src"), (F.col("n_regionkey").cast("long") + 3 * _SHIFT).alias("dst"))
    edges = customers.unionByName(suppliers).unionByName(nations)
    return Graph.of_edges(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.lit(1).cast("long").alias("weight")))


def event_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as documents: the user is the author, the event before is what it answers, its user is also mentioned; every third event
    replies to the user whose number is one higher."""
    p = event_pairs(spark, sf_dir)
    user, text = F.col("user_id"), F.col("user_id").cast("string")
    named, replied = F.col("p_user").isNotNull(), F.col("event_id") % 3 == 0
    made = p.select(
        F.col("event_id").alias("item_id"), F.col("event_type").alias("item_body"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("item_link"),
        F.col("ms").alias("item_publishDate"), user.alias("nick_id"), F.concat(F.lit("u"), text).alias("nick_name"),
        F.lit(1).cast("long").alias("item_activity"), user.alias("item_audience"),
        F.col("p_event").alias("item_parentId"), F.col("p_user").alias("item_parentNickId"), F.col("p_ms").alias("item_parentPublishDate"),
        F.array(F.col("event_id") % 7).alias("item_referenceIds"), F.array("event_type").alias("item_site"),
        F.when(named, F.array("p_user")).alias("item_mentionNickId"), F.when(named, F.array(F.concat(F.lit("u"), F.col("p_user").cast("string")))).alias("item_mentionNickName"),
        F.when(replied, F.array(user + 1)).alias("item_replyNickId"), F.when(replied, F.array(F.concat(F.lit("u"), (user + 1).cast("string")))).alias("item_replyNickName"),
    )
    kinds = {f.name: f.dataType for f in ITEMS}
    return made.select(*(F.col(n).cast(k).alias(n) if n in made.columns else F.lit(None).cast(k).alias(n) for n, k in kinds.items()))
