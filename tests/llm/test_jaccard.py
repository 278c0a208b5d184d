import itertools

import pytest
from pyspark.sql import functions as F

from graphloom.llm import jaccard
from graphloom.plans.stages import stage_rows

from .util import ODD, rows, table


def grams(text, n=3):
    w = (text or "").lower().split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(docs, threshold):
    sets = [(k, grams(t)) for k, t in docs]
    sets = [(k, g) for k, g in sets if g and k is not None]
    return {(min(a, b), max(a, b)): len(x & y) / len(x | y) for (a, x), (b, y) in itertools.combinations(sets, 2) if a != b and len(x & y) >= threshold * len(x | y)}


def grouped(docs, threshold):
    """(doc_id, class_id, links) by brute force."""
    want = brute(docs, threshold)
    least = {k: k for k, _ in docs if k is not None}
    links = dict.fromkeys(least, 0)
    for a, b in want:
        links[a] += 1
        links[b] += 1
    moved = True
    while moved:
        moved = False
        for a, b in want:
            m = min(least[a], least[b])
            moved |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return {k: (least[k], links[k]) for k in least}


def variants(n):
    """A family of texts that are alike to different degrees, some of them equal."""
    base = [f"w{k}" for k in range(40)]
    out = []
    for k in range(n):
        w = list(base)
        for j in range(k % 5):
            w[(7 * k + 11 * j) % 40] = f"x{k}-{j}"
        out.append((k, " ".join(w)))
    return out


def test_all_pairs_of_the_table(spark, sf_dir):
    table_ = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in table_.collect()]
    want, got = brute(docs, 0.5), rows(jaccard.pairs(table_))
    assert len({g[:2] for g in got}) == len(got) >= 0.95 * len(want) > 0
    for a, b, x in got:
        assert want[a, b] == pytest.approx(x)


def test_classes_of_the_table_are_those_of_its_pairs(spark, sf_dir):
    table_ = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found, want = {g[0]: g[1:] for g in rows(jaccard.classes(table_))}, grouped([(r.doc_id, r.text) for r in table_.collect()], 0.5)
    assert found.keys() == want.keys()
    assert sum(found[k] == want[k] for k in want) >= 0.99 * len(want)
    counted = {}
    for a, b, _ in rows(jaccard.pairs(table_)):
        counted[a], counted[b] = counted.get(a, 0) + 1, counted.get(b, 0) + 1
    assert {k: v[1] for k, v in found.items() if v[1]} == counted


SPLIT = [jaccard.Settings(), jaccard.Settings(small=6, depth=2), jaccard.Settings(small=3, depth=4)]


@pytest.mark.parametrize("s", SPLIT)
def test_large_buckets_are_split_and_nothing_is_capped(spark, s):
    docs = variants(60)
    want, got = brute(docs, 0.5), rows(jaccard.pairs(table(spark, docs), s))
    assert len({g[:2] for g in got}) == len(got) and {g[:2] for g in got} <= set(want)
    assert len(got) >= 0.98 * len(want)


@pytest.mark.parametrize("s", SPLIT)
def test_balls_count_what_comparing_counts(spark, s):
    """Two families of near copies, with copies among them, of which one is close enough to the other to be linked in part."""
    docs = variants(90) + [(1000 + k, t.replace("w3 ", "v3 ")) for k, t in variants(70)] + [(2000 + k, f"a text number {k} of its own kind entirely {k}") for k in range(20)]
    docs += [(3000 + k, docs[k][1]) for k in range(0, 60, 7)]
    want, got = grouped(docs, 0.5), {g[0]: g[1:] for g in rows(jaccard.classes(table(spark, docs), s))}
    assert got.keys() == want.keys()
    assert all(got[k][1] <= want[k][1] for k in want)
    assert sum(v[1] for v in got.values()) >= 0.98 * sum(v[1] for v in want.values())
    assert sum(got[k][0] == want[k][0] for k in want) >= 0.98 * len(want)


def test_a_large_group_of_near_copies_is_counted_whole(spark):
    """Every pair of these 1,500 is a link; all lie within a quarter of the first."""
    words = [f"w{k}" for k in range(200)]
    docs = [(k, " ".join(words[:100] + [f"u{k}"] + words[101:150 + k % 40])) for k in range(1500)]
    got = jaccard.classes(table(spark, docs)).groupBy("class_id", "links").count().collect()
    assert [(r.class_id, r.links, r["count"]) for r in got] == [(0, 1499, 1500)]


def cored(n, core=40):
    """n different texts with a common core: trigrams of the core are shared by all, those of the tails by none."""
    return [(k, " ".join([f"c{j}" for j in range(core)] + [f"t{k}-{j}" for j in range(14 + k % 5)])) for k in range(n)]


def test_sets_near_the_threshold_in_a_large_group_are_found(spark):
    n = 1800
    found = jaccard.pairs(table(spark, cored(n)))
    got = found.agg(F.count("*").alias("n"), F.count_distinct("doc_a", "doc_b").alias("d"), F.min("jaccard").alias("lo"), F.max("jaccard").alias("hi")).head()
    assert 38 / (38 + 36) == pytest.approx(got.lo) and got.hi == pytest.approx(38 / (38 + 28))
    assert got.n == got.d >= 0.98 * n * (n - 1) / 2


def test_split_buckets_keep_the_recall(spark):
    """Unlike groups with a common gram share buckets, so that these are split and not searched in blocks."""
    groups, size, s = 12, 24, jaccard.Settings(small=30)
    docs = [(size * g + k, " ".join([f"h{j}" for j in range(9)] + [f"g{g}-{j}" for j in range(30)] + [f"t{g}-{k}-{j}" for j in range(11 + k % 4)])) for g in range(groups) for k in range(size)]
    want = brute(docs, 0.5)
    got = rows(jaccard.pairs(table(spark, docs), s))
    assert len({g[:2] for g in got}) == len(got) and all(want[a, b] == pytest.approx(x) for a, b, x in got)
    assert len(got) >= 0.98 * len(want) > 0


def test_splits_and_balls_shuffle_no_sketches(spark):
    """Only to tell distinct sets are all sketches shuffled, though some buckets are split and others searched in blocks."""
    n, s = 3000, jaccard.Settings(small=100)
    docs = [(k, " ".join([f"h{j}" for j in range(4)] + [f"t{k}-{j}" for j in range(18)])) for k in range(n)] + [(n + k, t) for k, t in cored(300)]
    seen, held = max([r[0] for r in stage_rows(spark)], default=-1), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        join = jaccard.Join(table(spark, docs), s)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    wrote = [r[8] for r in stage_rows(spark) if r[0] > seen]
    assert join.balls is not None
    join.close()
    assert sum(b >= 4 * s.width * n for b in wrote) == 1, sorted(wrote)[-8:]


@pytest.mark.parametrize("s", [jaccard.Settings(), jaccard.Settings(depth=2), jaccard.Settings(threshold=0.7), jaccard.Settings(width=16)])
def test_splits_leave_the_recall(s):
    pools = s.splits()
    used = [*s.places(), *(p for pool in pools for p in pool.tolist())]
    assert len(set(used)) == len(used) and all(len(p) >= s.drawn(len(pools)) for p in pools)
    met = 1.0
    for _ in pools:
        met = 1 - (1 - s.threshold * met) ** s.drawn(len(pools))
    assert 1 - (1 - s.threshold * met) ** len(s.places()) >= s.recall


def test_copies_cost_a_row_each(spark):
    got = rows(jaccard.classes(table(spark, [(k, "one and the same text in every row") for k in range(500)] * 2)))
    assert sorted(got) == [(k, 0, 499) for k in range(500)]


def test_a_document_of_several_texts_joins_their_classes(spark):
    docs = [(1, "the first of the two texts here"), (2, "the first of the two texts here"), (2, "and here the second one of them"), (3, "and here the second one of them"), (4, "alone")]
    assert sorted(rows(jaccard.classes(table(spark, docs)))) == [(1, 1, 1), (2, 1, 2), (3, 1, 1), (4, 4, 0)]


def test_one_of_each_group_stays(spark):
    docs = [*variants(40), (100, "something else altogether stands here"), (101, None), (None, "no id at all in this row"), (102, "")]
    found = jaccard.keep_first(table(spark, docs))
    assert found.columns == table(spark, []).columns
    kept = {r.doc_id for r in found.collect()}
    assert {100, 101, None, 102} <= kept
    linked = {b for a, b in brute(docs, 0.5)}
    again = [(r.doc_id, r.text) for r in found.collect()]
    assert not any(r in brute(again, 0.8) for r in brute(again, 0.8))
    assert len(kept & linked) <= 0.05 * len(linked)


def test_odd_rows(spark):
    assert rows(jaccard.pairs(table(spark, ODD))) == []
    assert rows(jaccard.pairs(table(spark, []))) == rows(jaccard.classes(table(spark, []))) == []
    assert sorted(rows(jaccard.classes(table(spark, ODD)))) == [(k, k, 0) for k in range(1, 7)]
    assert rows(jaccard.keep_first(table(spark, []))) == []
    assert jaccard.keep_first(table(spark, ODD)).count() == len(ODD)
    short = [(1, "two words"), (2, "Two  WORDS"), (3, "two")]
    assert rows(jaccard.pairs(table(spark, short))) == [(1, 2, 1.0)]
