"""Graphs stored as GEXF, cut into elements side by side and parsed with a given schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import first_of, last_of, read_date
from ..graph import Graph
from ..schemas import METRICS

_VALUE = T.StructType([T.StructField("_for", T.StringType()), T.StructField("_value", T.StringType())])
_VALUES = T.StructField("attvalues", T.StructType([T.StructField("attvalue", T.ArrayType(_VALUE))]))
NODE = T.StructType([T.StructField("_id", T.LongType()), T.StructField("_label", T.StringType()), _VALUES])
EDGE = T.StructType([T.StructField(n, T.StringType() if n in ("_label", "_id") else T.LongType()) for n in ("_id", "_source", "_target", "_weight", "_label")] + [_VALUES])

#: Attribute names of a file's vertices and the columns they fill.
VERTEX_ATTRIBUTES = {
    "NAME": "nickName", "ALL-NICK-ACTIVITY-EVER": "activity", "NICK-FOLLOWERS": "rating", "COUNTRY": "country", "LOCATION": "location", "WEBSITE": "webSite",
    "FIRST PUBDATE": "firstItemDate", "LAST PUBDATE": "lastItemDate", "Urls Sent": "urlNumber", "Domains Sent": "domainNumber",
}
_DATES = ("firstItemDate", "lastItemDate")
_NUMBERS = {"activity": "bigint", "rating": "bigint", "urlNumber": "int", "domainNumber": "int"}


def _map(df: DataFrame) -> DataFrame:
    entries = F.transform(F.coalesce(F.col("attvalues.attvalue"), F.array().cast(T.ArrayType(_VALUE))), lambda x: F.struct(x["_for"].alias("k"), x["_value"].alias("v")))
    return df.withColumn("a", F.map_from_entries(F.filter(entries, lambda x: x["k"].isNotNull())))


def _get(name: str) -> Column:
    return F.try_element_at("a", F.lit(name))


def metrics_found(nodes: DataFrame) -> list[str]:
    """The metric columns that any vertex of the file has."""
    names = {c.upper(): c for c in METRICS}
    rows = nodes.select(F.explode(F.map_keys("a")).alias("k")).where(F.upper("k").isin(*names)).distinct().collect()  # at most as many as there are metrics
    found = {names[r["k"].upper()] for r in rows}
    return [c for c in METRICS if c in found]


_CORRUPT = "_corrupt_record"
_FORMAT = "org.apache.spark.sql.execution.datasources.xml.XmlInputFormat"


def _hides_tags(spark: SparkSession, path: str) -> bool:
    """Whether a file has comments or unparsed text, in which tags are no elements."""
    heads = spark.read.option("lineSep", "<").text(path).where(F.col("value").startswith("!--") | F.col("value").startswith("![CDATA["))
    return not heads.isEmpty()


def _elements(spark: SparkSession, path: str, tag: str, kind: T.StructType, whole: bool, split: int) -> DataFrame:
    """The elements of a tag, malformed ones left out. Spark's XML source reads a file of many lines in one task, so ranges of the file are
    searched for elements instead, unless it has to be read as a whole to tell them."""
    if whole:
        return spark.read.format("xml").option("mode", "DROPMALFORMED").option("rowTag", tag).schema(kind).load(path)
    conf = {"xmlinput.start": f"<{tag}>", "xmlinput.end": f"</{tag}>", "xmlinput.encoding": "UTF-8", "mapreduce.input.fileinputformat.split.maxsize": str(split)}
    texts = spark.sparkContext.newAPIHadoopFile(path, _FORMAT, "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.Text", conf=conf).values().map(lambda text: (text,))
    rows = spark.createDataFrame(texts, "value string", verifySchema=False)
    read = rows.select(F.from_xml("value", T.StructType([*kind, T.StructField(_CORRUPT, T.StringType())]), {"mode": "PERMISSIVE"}).alias("x"))
    return read.where(f"x.{_CORRUPT} is null").select(*(f"x.{n}" for n in kind.fieldNames()))


def read_gexf(spark: SparkSession, path: str, split: int = 32 << 20) -> Graph:
    """Vertices with their attributes and whatever metrics the file has; an edge without a weight has 1."""
    whole = _hides_tags(spark, path)
    nodes = _map(_elements(spark, path, "node", NODE, whole, split))
    kept = metrics_found(nodes)
    fields = {column: _get(name) for name, column in VERTEX_ATTRIBUTES.items()}
    shown = [(read_date(c) if n in _DATES else F.expr(f"try_cast(a['{k}'] as {_NUMBERS[n]})") if n in _NUMBERS else c).alias(n) for k, (n, c) in zip(VERTEX_ATTRIBUTES, fields.items())]
    scores = [F.expr(f"try_cast(coalesce(try_element_at(a, '{m.upper()}'), try_element_at(a, '{m}')) as {METRICS[m].simpleString()})").alias(m) for m in kept]
    vertices = nodes.where("_id is not null").select(F.col("_id").alias("id"), *shown, F.lit(False).alias("parentData"), *scores)

    edges = _map(_elements(spark, path, "edge", EDGE, whole, split)).where("_source is not null and _target is not null")
    links = _get("LINKS")
    edges = edges.select(
        F.col("_source").alias("src"), F.col("_target").alias("dst"), F.coalesce("_weight", F.lit(1).cast("long")).alias("weight"),
        first_of(F.col("_label")).alias("firstItemBody"), last_of(F.col("_label")).alias("lastItemBody"), first_of(links).alias("firstItemLink"), last_of(links).alias("lastItemLink"),
        read_date(_get("FIRST PUBDATE")).alias("firstItemDate"), read_date(_get("LAST PUBDATE")).alias("lastItemDate"),
    )
    return Graph(vertices, edges)
