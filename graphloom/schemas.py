"""Schemas of the documents that networks are built from, and of vertices and edges."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT, _LONG = T.StringType(), T.LongType()


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k, True) for n, k in kinds.items()])


def _people(prefix: str) -> dict[str, T.DataType]:
    return {
        f"item_{prefix}NickId": T.ArrayType(_LONG),
        f"item_{prefix}NickName": T.ArrayType(_TEXT),
        f"item_{prefix}NickActivity": T.ArrayType(_LONG),
        f"item_{prefix}NickAudience": T.ArrayType(_LONG),
    }


#: One post, with what is known of its author, of the post it answers, and of the people it names.
ITEMS = _struct(
    item_id=_LONG, item_title=_TEXT, item_link=_TEXT, item_body=_TEXT, item_parentId=_LONG, item_publishDate=_LONG,
    publisher_id=_LONG, publisher_description=_TEXT, nick_id=_LONG, nick_name=_TEXT, item_activity=_LONG, item_audience=_LONG,
    person_location=_TEXT, person_country=_TEXT, person_website=_TEXT,
    item_referenceIds=T.ArrayType(_LONG), item_referenceUrls=T.ArrayType(_TEXT), item_site=T.ArrayType(_TEXT),
    **_people("mention"), **_people("reply"),
    item_parentPublishDate=_LONG, item_parentLink=_TEXT, item_parentNickId=_LONG, item_parentNickName=_TEXT,
    item_parentNickActivity=_LONG, item_parentAudience=_LONG,
)

PERSON = _struct(authorId=_LONG, authorName=_TEXT, authorActivity=_LONG, authorRating=_LONG)

VERTEX = _struct(
    id=_LONG, nickName=_TEXT, activity=_LONG, rating=_LONG, country=_TEXT, location=_TEXT, webSite=_TEXT,
    firstItemDate=_LONG, lastItemDate=_LONG, urlNumber=T.IntegerType(), domainNumber=T.IntegerType(), parentData=T.BooleanType(),
)

EDGE = _struct(
    src=_LONG, dst=_LONG, weight=_LONG, firstItemBody=_TEXT, lastItemBody=_TEXT, firstItemLink=_TEXT, lastItemLink=_TEXT,
    firstItemDate=_LONG, lastItemDate=_LONG,
)

#: Metric columns and their types.
METRICS: dict[str, T.DataType] = {
    "degree": _LONG, "inDegree": _LONG, "outDegree": _LONG, "weightedDegree": _LONG, "weightedInDegree": _LONG, "weightedOutDegree": _LONG,
    "eigenCentrality": T.DoubleType(), "betweennessCentrality": T.DoubleType(), "pageRank": T.DoubleType(), "modularity": _LONG, "component": _LONG,
}
