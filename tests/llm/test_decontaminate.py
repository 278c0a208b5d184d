import random

import pyarrow as pa
import pytest

from graphloom.llm import decontaminate as dc
from graphloom.llm.arrays import flat

from .util import ODD, rows, table

S = dc.Settings()
WORDS = [f"{a}{b}{c}" for a in ("bra", "tol", "min", "ser") for b in ("ka", "vo", "li") for c in ("n", "st", "rum", "d")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def folded(text):
    data, offsets = dc.folded(*flat(pa.array([(text or "").lower()], pa.large_string())))
    return data[:-1].tobytes()


def windows(text, s):
    whole = folded(text).strip()
    if len(whole) < s.q:
        return []
    last = max(0, len(whole) - s.window)
    return [whole[a : a + s.window] for a in sorted({*range(0, last + 1, s.window // 2), last})]


def least_edits(part, text):
    """Edits of the best place of part in text, by the plain recursion."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(part, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def budget(part, s):
    return int(s.rate * len(part))


def brute(docs, items, s):
    return {(k, i) for k, t in docs for i, x in items if any(least_edits(w, folded(t)) <= budget(w, s) for w in windows(x, s))}


def spoiled(rng, text, n):
    out = list(text)
    for _ in range(n):
        k = rng.randrange(len(out))
        out[k : k + 1] = rng.choice([[], ["q"], [out[k], "z"]])
    return "".join(out)


def bench(spark, items):
    return spark.createDataFrame([(i, x, "c", 1, 2) for i, x in items], "item_id long, text string, doc_id string, start int, lang int")


def test_against_brute_force(spark):
    rng = random.Random(3)
    items = [(1, prose(rng, 30)), (2, prose(rng, 45)), (3, prose(rng, 4)), (4, "tiny"), (5, None), (6, "")]
    docs = [(k, prose(rng, 20)) for k in range(4)]
    for n in (0, 3, 6, 9, 12, 16, 24):
        for i in (0, 1):
            docs.append((len(docs), prose(rng, 10) + ", " + spoiled(rng, items[i][1], n).upper() + "! " + prose(rng, 10)))
    docs.append((len(docs), "see: " + items[2][1] + "."))
    found = dc.matches(table(spark, docs), bench(spark, items), S).collect()
    assert {(r.doc_id, r.item_id) for r in found} == brute(docs, items, S)
    assert len({(r.doc_id, r.item_id) for r in found}) == len(found) > 8
    kept = {r.doc_id for r in dc.clean(table(spark, docs), bench(spark, items), S).collect()}
    assert kept == {k for k, _ in docs} - {r.doc_id for r in found}


def test_items_shorter_than_a_window_keep_their_budget(spark):
    """Lengths at which q-grams of ten bytes would leave none for all edits."""
    rng = random.Random(11)
    lengths = [10, 12, 13, 16, 19, 20, 25, 27, 29, 30, 38, 39, 44, 50, 61]
    items = [(m, "".join(rng.choice("abcdefghij klmnop") for _ in range(m - 2)).strip().ljust(m - 1, "x") + "y") for m in lengths]
    docs = []
    for m, x in items:
        for n in range(6):
            docs.append((len(docs), f"{prose(rng, 5)} {spoiled(rng, x, n)} {prose(rng, 5)}"))
    found = {(r.doc_id, r.item_id) for r in dc.matches(table(spark, docs), bench(spark, items)).collect()}
    assert found == brute(docs, items, S)
    assert {S.edits(m) for _, m in found} >= {0, 1, 2, 3} and {S.q_of(m) for m in lengths} >= {6, 8, 9, 10}


@pytest.mark.parametrize("wrong", [{"window": 4096}, {"q": 1}, {"q": 20}, {"rate": 0.6}])
def test_settings_that_the_keys_cannot_hold_are_errors(wrong):
    with pytest.raises(ValueError):
        dc.Settings(**wrong)


def test_the_best_of_several_places_is_given(spark):
    rng = random.Random(6)
    x = prose(rng, 9)[:60].strip() + "zz"
    spoilt = x[:20] + "q" + x[21:]
    got = dc.matches(table(spark, [(1, f"{spoilt} and {x} and {x}")]), bench(spark, [(1, x)])).collect()
    assert [(r.start, r.edits) for r in got] == [(len(spoilt) + 5, 0)]


def test_slices_of_the_benchmark(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(rows(dc.matches(docs, items)))
    assert whole and sorted(rows(dc.matches(docs, items, dc.Settings(slice_bytes=3000)))) == whole
    # every document that holds an item word for word is found
    exact = {(d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if d.text and len(folded(i.text).strip()) >= S.q and folded(i.text).strip() in folded(d.text)}
    assert exact <= {r[:2] for r in whole}


def test_best_place_is_told(spark):
    rng = random.Random(5)
    item = prose(rng, 12)
    got = dc.matches(table(spark, [(1, "front words " + item + " back words")]), bench(spark, [(9, item), (9, item)])).collect()
    assert {(r.start, r.end, r.edits, r.similarity) for r in got} == {(12, 12 + len(item), 0, 1.0)}


def test_passages_cut_at_both_ends_are_found(spark):
    """Any verbatim run of a window and a half, wherever it begins and ends; it is reported as far as its windows reach."""
    rng = random.Random(9)
    items = [(k, prose(rng, 32)) for k in range(40)]
    least = 96
    docs, size = [], {}
    for k, x in items:
        n = rng.randrange(least, 160)
        a = rng.randrange(1, len(x) - n)
        docs.append((k, f"{prose(rng, 12)} | {x[a : a + n]} | {prose(rng, 12)}"))
        size[k] = n
    got = {(r.doc_id, r.item_id): r for r in dc.matches(table(spark, docs), bench(spark, items)).collect()}
    assert {(k, k) for k in size} <= set(got)
    assert all(got[k, k].edits <= 8 and got[k, k].end - got[k, k].start > size[k] - 2 * (S.window // 2) - 4 for k in size)
    assert dc.clean(table(spark, docs), bench(spark, items)).count() == 0


def test_odd_rows(spark):
    items = bench(spark, [(1, prose(random.Random(1), 20)), (None, "same text twice over here")])
    got = rows(dc.matches(table(spark, ODD), items))
    assert [r[:2] for r in got] == [(5, None), (5, None)]
    assert dc.clean(table(spark, ODD), items).count() == len(ODD) - 2
    assert dc.clean(table(spark, ODD), items).columns == table(spark, []).columns
    assert rows(dc.matches(table(spark, []), items)) == [] == rows(dc.matches(table(spark, ODD), items.where("false")))
    assert dc.clean(table(spark, ODD), items.where("false")).count() == len(ODD)
