"""Scalar expressions shared by sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_FORMAT = "dd/MM/yyyy HH:mm"
#: Twelve-hour pattern without a half-day mark, for files that were written with it; afternoons can't be told from mornings.
OLD_DATE_FORMAT = "dd/MM/yyyy hh:mm"
PAIR = "||"


def zero(c: Column) -> Column:
    """Numbers that a document lacks count as 0."""
    return F.coalesce(c.cast("long"), F.lit(0).cast("long"))


def blank(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def escaped(c: Column) -> Column:
    """XML text; null stays null."""
    for sign, name in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def shown_date(millis: Column, pattern: str = DATE_FORMAT) -> Column:
    return F.date_format(F.timestamp_millis(millis), pattern)


def read_date(text: Column) -> Column:
    """Epoch milliseconds of either date pattern."""
    return F.unix_millis(F.coalesce(F.try_to_timestamp(text, F.lit(DATE_FORMAT)), F.try_to_timestamp(text, F.lit(OLD_DATE_FORMAT))))


def first_of(c: Column) -> Column:
    return F.split(c, r"[|][|]")[0]


def last_of(c: Column) -> Column:
    return F.element_at(F.split(c, r"[|][|]"), -1)


def pair(first: Column, last: Column, many: Column) -> Column:
    """first, or first||last where an edge stands for several items."""
    return F.when(many, F.concat(blank(first), F.lit(PAIR), blank(last))).otherwise(first)


def zipped(ids: Column, names: Column, activity: Column, audience: Column) -> Column:
    """Parallel arrays as an array of people; null where there are no ids."""
    people = F.transform(
        ids, lambda x, k: F.struct(x.alias("authorId"), F.get(names, k).alias("authorName"), zero(F.get(activity, k)).alias("authorActivity"), zero(F.get(audience, k)).alias("authorRating"))
    )
    return F.when(ids.isNotNull(), F.filter(people, lambda p: p["authorId"].isNotNull()))


def size_text(n: float) -> str:
    """A number of bytes for people: 4.0 MB."""
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if n < 1024 or unit == "TB":
            return f"{n:.1f} {unit}"
        n /= 1024
    raise AssertionError


def time_text(ms: float) -> str:
    """A time for people: 1.2 min."""
    for most, by, unit in ((1000, 1, "ms"), (60_000, 1000, "s"), (3_600_000, 60_000, "min")):
        if ms < most:
            return f"{ms / by:.1f} {unit}"
    return f"{ms / 3_600_000:.1f} h"
