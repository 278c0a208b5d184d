"""How often tables are gone through, and how much of them a task gets."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import construction as c
from graphloom.plans import adapters
from graphloom.plans import queries as q


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def checkpoints(monkeypatch, module):
    taken = []
    real = module.cut
    monkeypatch.setattr(module, "cut", lambda df: taken.append(df.columns) or real(df))
    return taken


@pytest.mark.parametrize("size", [7, 300, 50_000])
def test_events_with_the_one_before_over_ranges(spark, sf_dir, monkeypatch, size):
    monkeypatch.setattr(adapters, "_RANGE", size)
    pairs = adapters.event_pairs(spark, sf_dir)
    rows = [(r.event_id, r.user_id, r.p_event, r.p_user, r.p_ms) for r in pairs.orderBy("ts", "event_id").collect()]
    events = adapters.table(spark, sf_dir, "events")
    ordered = events.select("event_id", "user_id", adapters.millis(events, "ts").alias("ms")).orderBy("ts", "event_id").collect()
    want = [(b.event_id, b.user_id, *((a.event_id, a.user_id, a.ms) if a else (None, None, None))) for a, b in zip([None, *ordered], ordered)]
    assert rows == want


def test_no_join_of_all_events(spark, sf_dir):
    found = plan(adapters.event_pairs(spark, sf_dir))
    assert "SortMergeJoin" not in found and "ShuffledHashJoin" not in found


@pytest.mark.parametrize("rows", [c.ego_vertices, c.ego_edges, c.author_vertices, c.author_edges])
def test_one_pass_over_documents(spark, sf_dir, rows):
    found = plan(rows(c.ego_items(adapters.event_items(spark, sf_dir))))
    assert "Union" not in found and found.count("Exchange hashpartitioning(_part") <= 2  # ranges, and their last events


def test_rows_of_documents(spark):
    raw = spark.createDataFrame([(1, None, 5), (2, 1, 6)], "item_id long, item_parentId long, nick_id long")
    people = {f"item_{kind}Nick{part}": F.lit(None).cast(f"array<{t}>") for kind in ("mention", "reply") for part, t in (("Id", "bigint"), ("Name", "string"), ("Activity", "bigint"), ("Audience", "bigint"))}
    more = ("item_body", "item_link", "nick_name", "person_country", "person_location", "person_website", "item_parentNickName")
    numbers = ("item_publishDate", "item_parentPublishDate", "item_activity", "item_audience", "item_parentNickId", "item_parentNickActivity", "item_parentAudience")
    raw = raw.withColumns(people | {n: F.lit(None).cast("string") for n in more} | {n: F.lit(None).cast("long") for n in numbers} | {"item_referenceIds": F.lit(None).cast("array<bigint>"), "item_site": F.lit(None).cast("array<string>")})
    raw = raw.withColumns({"item_mentionNickId": F.expr("case when item_id = 1 then array(9, null, 9) end"), "item_replyNickId": F.expr("array(nick_id)")})
    items = c.ego_items(raw)
    assert sorted((r.src, r.dst, r.order) for r in c.ego_edges(items).collect()) == [(5, 5, 1), (5, 9, 1), (5, 9, 1), (6, 0, 2), (6, 6, 2)]
    assert sorted((r.id, r.order, r.parentData) for r in c.ego_vertices(items).collect()) == [(0, 2, True), (5, 1, False), (5, 1, True), (6, 2, False), (6, 2, True), (9, 1, True), (9, 1, True)]


def test_a_stored_graph_is_merged_once(spark, sf_dir, monkeypatch):
    taken = checkpoints(monkeypatch, q)
    q._stored(spark, sf_dir)
    assert [("id" in columns, "degree" in columns) for columns in taken] == [(True, False), (False, False), (True, True)]


def test_partitions_are_aggregated_in_many_tasks(spark, sf_dir):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 6)
    try:
        assert plan(q.partitioned_edges(spark, sf_dir)).count("REPARTITION_BY_NUM") == 8
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("name", ["dangling_ends", "drop_isolated"])
def test_ends_need_no_merged_edges(spark, sf_dir, monkeypatch, name):
    monkeypatch.setattr(adapters, "merged_edges", None)
    assert q.queries()[name](spark, sf_dir).count() > 0
