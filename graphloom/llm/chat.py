"""Chat formatting: a finite-state machine over roles checks the order of turns, and a declarative template turns each accepted
conversation into text segments with a loss flag each.

Everything is built from column expressions; one shuffle brings the turns of a conversation together.

Defined cases: rows with a null conv_id are left out; equal rows count once; a conversation is rejected if two different rows
have the same turn, if a turn's number, role or text is null, if a text is blank (nothing but ASCII white space), if a role has no arc from the state reached, or if
it ends in a state that doesn't accept. Gaps between turn numbers are allowed. A rejected conversation gives one row of segment
-1 with an empty text and no loss; segments that belong to no turn have an empty role. Other columns are ignored; an empty table gives no rows; texts are kept whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """`arcs`: state -> role -> next state. `parts`: role -> (text, loss) pairs, a text of None is the turn's own."""

    start: str = "start"
    arcs: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "told", "user": "asked"},
            "told": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked again"},
            "asked again": {"assistant": "answered"},
        }
    )
    accepting: tuple[str, ...] = ("answered", "asked again")
    opening: tuple[tuple[str, bool], ...] = (("<|begin|>", False),)
    parts: dict[str, tuple[tuple[str | None, bool], ...]] = field(
        default_factory=lambda: {
            "system": (("<|system|>\n", False), (None, False), ("<|end|>\n", False)),
            "user": (("<|user|>\n", False), (None, False), ("<|end|>\n", False)),
            "assistant": (("<|assistant|>\n", False), (None, True), ("<|end|>\n", True)),
        }
    )


def _next(template: Template, state: Column, role: Column) -> Column:
    arcs = [x for s, by in template.arcs.items() for r, to in by.items() for x in (F.lit(f"{s}\n{r}"), F.lit(to))]
    return F.coalesce(F.try_element_at(F.create_map(*arcs), F.concat(state, F.lit("\n"), F.coalesce(role, F.lit("")))), F.lit("rejected"))


def checked(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, turns, status): turns in order; status is ok or rejected."""
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))
    end = F.aggregate("turns", F.lit(template.start), lambda state, t: _next(template, state, t["role"]))
    sound = F.forall("turns", lambda t: t["turn"].isNotNull() & t["role"].isNotNull() & F.coalesce(t["text"].rlike(r"[^ \t\n\x0b\f\r]"), F.lit(False)))
    once = F.size(F.array_distinct(F.transform("turns", lambda t: t["turn"]))) == F.size("turns")
    return turns.withColumn("status", F.when(sound & once & end.isin(*template.accepting), "ok").otherwise("rejected"))


def _segment(role: Column, text: Column, loss: bool) -> Column:
    return F.struct(role.alias("role"), text.alias("text"), F.lit(loss).alias("loss"))


def formatted(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, status, segment, role, text, loss): the segments of each conversation in order."""

    def of(turn: Column) -> Column:
        out = F.array().cast("array<struct<role:string,text:string,loss:boolean>>")
        for role, parts in template.parts.items():
            out = F.when(turn["role"] == role, F.array(*[_segment(turn["role"], turn["text"] if t is None else F.lit(t), loss) for t, loss in parts])).otherwise(out)
        return out

    opening = F.array(*[_segment(F.lit(""), F.lit(t), loss) for t, loss in template.opening])
    segments = F.when(F.col("status") == "ok", F.concat(opening, F.flatten(F.transform("turns", of))))
    return checked(conversations, template).select("conv_id", "status", F.posexplode_outer(segments).alias("segment", "s")).select(
        "conv_id", "status", F.coalesce("segment", F.lit(-1)).alias("segment"), *(F.coalesce(F.col(f"s.{c}"), F.lit(none)).alias(c) for c, none in (("role", ""), ("text", ""), ("loss", False)))
    )


#: The same with the machine written as a regular expression over the roles' initials.
SQL = r"""
WITH rows AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
seq AS (
  SELECT conv_id, string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn) AS roles,
         count(*) = count(DISTINCT turn) AND bool_and(turn IS NOT NULL AND regexp_matches(coalesce(text, ''), '[^ \t\n\x0b\f\r]')) AS sound
  FROM rows GROUP BY conv_id
), judged AS (SELECT conv_id, CASE WHEN sound AND regexp_full_match(roles, 's?(ua)+u?') THEN 'ok' ELSE 'rejected' END AS status FROM seq),
good AS (SELECT r.*, 3 * (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS base FROM rows r JOIN judged USING (conv_id) WHERE status = 'ok')
SELECT conv_id, status, -1 AS segment, '' AS role, '' AS text, false AS loss FROM judged WHERE status = 'rejected'
UNION ALL SELECT conv_id, status, 0, '', '<|begin|>', false FROM judged WHERE status = 'ok'
UNION ALL SELECT conv_id, 'ok', CAST(base + 1 AS INTEGER), role, '<|' || role || '|>' || chr(10), false FROM good
UNION ALL SELECT conv_id, 'ok', CAST(base + 2 AS INTEGER), role, text, role = 'assistant' FROM good
UNION ALL SELECT conv_id, 'ok', CAST(base + 3 AS INTEGER), role, '<|end|>' || chr(10), role = 'assistant' FROM good
"""
