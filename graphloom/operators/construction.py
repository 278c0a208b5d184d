"""Networks from documents: authors as vertices, answers, mentions and replies as edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import zero, zipped

_ATTRIBUTES = ("nickName", "activity", "rating", "country", "location", "webSite")


def author_items(raw: DataFrame) -> DataFrame:
    """Documents with the defaults of absent numbers; absent texts stay null."""
    return raw.select(*author_columns())


def author_columns() -> list[Column]:
    return [
        F.col("item_id").alias("itemId"), zero(F.col("item_parentId")).alias("parentId"), F.col("item_body").alias("body"), F.col("item_link").alias("link"),
        zero(F.col("item_publishDate")).alias("date"), zero(F.col("item_parentPublishDate")).alias("parentDate"),
        zero(F.col("nick_id")).alias("nickId"), F.col("nick_name").alias("nickName"), zero(F.col("item_activity")).alias("activity"), zero(F.col("item_audience")).alias("rating"),
        F.col("person_country").alias("country"), F.col("person_location").alias("location"), F.col("person_website").alias("webSite"),
        F.col("item_referenceIds").alias("urls"), F.col("item_site").alias("hosts"),
        zero(F.col("item_parentNickId")).alias("parentNickId"), F.col("item_parentNickName").alias("parentNickName"),
        zero(F.col("item_parentNickActivity")).alias("parentActivity"), zero(F.col("item_parentAudience")).alias("parentRating"),
    ]


def ego_items(raw: DataFrame) -> DataFrame:
    """As `author_items`, with the people that a document mentions and replies to."""
    people = {kind: zipped(*(F.col(f"item_{kind}Nick{part}") for part in ("Id", "Name", "Activity", "Audience"))) for kind in ("mention", "reply")}
    return raw.select(*author_columns(), people["mention"].alias("mentions"), people["reply"].alias("replies"))


_KINDS = {"id": "long", "nickName": "string", "activity": "long", "rating": "long", "country": "string", "location": "string", "webSite": "string", "first": "long", "last": "long", "urls": "array<bigint>", "hosts": "array<string>", "order": "long"}


def _vertex(of: dict[str, Column], parent: bool) -> Column:
    return F.struct(*(of.get(c, F.lit(None)).cast(t).alias(c) for c, t in _KINDS.items()), F.lit(parent).alias("parentData"))


def _author_rows() -> list[Column]:
    own = {"id": F.col("nickId"), "first": F.col("date"), "last": F.col("date"), "order": F.col("itemId")} | {c: F.col(c) for c in (*_ATTRIBUTES, "urls", "hosts")}
    parents = {"id": F.col("parentNickId"), "nickName": F.col("parentNickName"), "activity": F.col("parentActivity"), "rating": F.col("parentRating"), "first": F.col("parentDate"), "last": F.col("parentDate"), "order": F.col("itemId")}
    return [F.array(_vertex(own, False)), F.when(F.col("parentId") > 0, F.array(_vertex(parents, True)))]


def _all_of(items: DataFrame, arrays: list[Column], *columns: Column) -> DataFrame:
    """Columns of the items and, in x, each element of the arrays, absent ones left out; a single pass over the items."""
    return items.select(*columns, F.explode(F.flatten(F.filter(F.array(*arrays), lambda a: a.isNotNull()))).alias("x"))


def author_vertices(items: DataFrame) -> DataFrame:
    """A row for each author of a document and each author of a document's parent, not yet merged."""
    return _all_of(items, _author_rows()).select("x.*")


def ego_vertices(items: DataFrame) -> DataFrame:
    """As `author_vertices`, and a row for each person mentioned or replied to; these have no dates."""

    def person(p: Column) -> Column:
        return _vertex({"id": p["authorId"], "nickName": p["authorName"], "activity": p["authorActivity"], "rating": p["authorRating"], "order": F.col("itemId")}, True)

    return _all_of(items, [*_author_rows(), *(F.transform(c, person) for c in ("mentions", "replies"))]).select("x.*")


def merged_vertices(rows: DataFrame) -> DataFrame:
    """One row for each author: attributes of the earliest document of their own, else of the earliest that names them; first and
    last date over all rows; numbers of distinct urls and hosts over their own documents."""
    rank = F.struct(F.col("parentData"), F.coalesce(F.col("first"), F.lit(2**63 - 1)), F.col("order"))
    picked = F.min_by(F.struct(*_ATTRIBUTES), rank)
    sets = {n: F.size(F.array_distinct(F.flatten(F.collect_set(F.when(~F.col("parentData"), F.filter(c, lambda x: x.isNotNull())))))) for n, c in (("urlNumber", "urls"), ("domainNumber", "hosts"))}
    found = rows.groupBy("id").agg(picked.alias("p"), F.min("first").alias("firstItemDate"), F.max("last").alias("lastItemDate"), *(c.cast("int").alias(n) for n, c in sets.items()), F.min("parentData").alias("parentData"))
    return found.select("id", *(F.col(f"p.{c}").alias(c) for c in _ATTRIBUTES), "firstItemDate", "lastItemDate", "urlNumber", "domainNumber", "parentData")


def author_edges(items: DataFrame) -> DataFrame:
    """An edge from the author of each answer to the author of what it answers."""
    return _edges(items, [])


def _edges(items: DataFrame, more: list[Column]) -> DataFrame:
    answered = F.when(F.col("parentId") > 0, F.array("parentNickId"))
    columns = F.col("nickId").alias("src"), F.lit(1).cast("long").alias("weight"), F.col("body"), F.col("link"), F.col("date"), F.col("itemId").alias("order")
    return _all_of(items, [answered, *more], *columns).select("src", F.col("x").alias("dst"), "weight", "body", "link", "date", "order")


def ego_edges(items: DataFrame) -> DataFrame:
    """As `author_edges`, and edges to those whom a document mentions or replies to."""
    return _edges(items, [F.transform(c, lambda p: p["authorId"]) for c in ("mentions", "replies")])


def merged_edges(rows: DataFrame) -> DataFrame:
    """Parallel edges as one: weights add up, text and link come from the first and the last item, the item's id breaks ties."""
    at = F.struct("date", "order")
    first, last = F.min_by(F.struct("body", "link"), at), F.max_by(F.struct("body", "link"), at)
    found = rows.groupBy("src", "dst").agg(F.sum("weight").alias("weight"), first.alias("f"), last.alias("l"), F.min("date").alias("firstItemDate"), F.max("date").alias("lastItemDate"))
    return found.select(
        "src", "dst", "weight", F.col("f.body").alias("firstItemBody"), F.col("l.body").alias("lastItemBody"),
        F.col("f.link").alias("firstItemLink"), F.col("l.link").alias("lastItemLink"), "firstItemDate", "lastItemDate",
    )


def once(items: DataFrame) -> DataFrame:
    """Each document once."""
    return items.dropDuplicates(["item_id"])


def latest_authors(raw: DataFrame, k: int) -> DataFrame:
    """The k authors of some documents, or of what these answer, who were active last."""
    return merged_vertices(author_vertices(author_items(raw))).orderBy(F.desc("lastItemDate"), "id").limit(k).select("id")


def ego_expansion(raw: DataFrame, ego: int, k: int = 25) -> DataFrame:
    """Documents by or to one author, then all by or to the k authors of these who were active last, each once."""
    seeds = raw.where((F.col("nick_id") == ego) | (F.col("item_parentNickId") == ego))
    people = F.broadcast(latest_authors(seeds, k))  # k rows
    by = raw.join(people, raw["nick_id"] == people["id"], "left_semi")
    to = raw.join(people, raw["item_parentNickId"] == people["id"], "left_semi")
    return once(seeds.unionByName(by).unionByName(to))
