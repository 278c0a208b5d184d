import numpy as np
import pytest

from graphloom.llm import line_dedup

from .util import rows, table

LONG = "this line is longer than twenty bytes"


def brute(docs, least=20):
    owner = {}
    for k, t in docs:
        for x in (t or "").split("\n"):
            if len(x.encode()) >= least:
                owner[x] = min(owner.get(x, line_dedup.LAST), line_dedup.LAST if k is None else k)
    out = []
    for k, t in docs:
        seen, kept, gone = set(), [], 0
        for x in (t or "").split("\n"):
            if len(x.encode()) >= least and (owner[x] != (line_dedup.LAST if k is None else k) or x in seen):
                gone += 1
                continue
            seen.add(x)
            kept.append(x)
        out.append((k, None if t is None else "\n".join(kept), gone))
    return sorted(out, key=str)


DOCS = [
    (3, f"{LONG}\nshort\nanother line that is long enough"), (1, f"own opening line of the first one\n{LONG}\n{LONG}"), (2, LONG), (4, f"\n\n{LONG}\n\nshort\nshort\n"),
    (5, None), (6, ""), (7, "\n"), (None, f"{LONG}\nonly in the row without an id"), (8, "zażółć gęślą jaźń zażółć\nzażółć gęślą jaźń zażółć"), (9, f"short\n{LONG}"), (10, f"{LONG}\n"),
]


@pytest.mark.parametrize("s", [line_dedup.Settings(), line_dedup.Settings(shard_lines=2, salts=2)])
def test_against_brute_force(spark, s):
    got = rows(line_dedup.rewritten(table(spark, DOCS).select("doc_id", "text"), s, counter="removed"))
    assert sorted(got, key=str) == brute(DOCS)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = rows(line_dedup.rewritten(docs.select("doc_id", "text"), counter="removed"))
    assert sorted(got, key=str) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_other_columns_stay(spark):
    got = line_dedup.rewritten(table(spark, DOCS))
    assert got.columns == table(spark, []).columns
    assert all(r.n_chars == (None if r.text is None else len(r.text)) and (r.doc, r.gone) == ("x", 1) for r in got.collect())


def test_emptied_documents_go(spark):
    kept = {r.doc_id for r in line_dedup.rewritten(table(spark, DOCS), drop_emptied=True).collect()}
    assert kept == {1, 3, 4, 5, 6, 7, 8, 9, None}  # 2 and 10 had nothing else


def test_empty_table_and_repeated_rows(spark):
    assert rows(line_dedup.rewritten(table(spark, []))) == []
    got = rows(line_dedup.rewritten(table(spark, [(1, LONG), (1, LONG)]).select("doc_id", "text")))
    assert got == [(1, LONG), (1, LONG)]


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 20_000, dtype=np.uint64))
    mph = line_dedup.PerfectHash.build(keys)
    assert sorted(mph.places(keys).tolist()) == list(range(len(keys)))
    again = line_dedup.PerfectHash.unpacked(*mph.packed())
    assert (again.places(keys) == mph.places(keys)).all()


def test_probe_gives_counts_and_owners(spark):
    folder, shards, total = line_dedup.build_index(table(spark, DOCS))
    assert (shards, total) == (1, 5)
    count, owner = line_dedup.Shard(folder, 0).probe(np.array([5, 6], np.uint64))  # foreign keys
    assert count.tolist() == [0, 0] and owner.tolist() == [line_dedup.LAST] * 2
    assert sorted(line_dedup.Shard(folder, 0).counts.tolist()) == [1, 1, 1, 1, 7]


def test_a_counter_may_not_take_the_name_of_a_column(spark):
    with pytest.raises(ValueError):
        line_dedup.rewritten(table(spark, DOCS), counter="Gone")


@pytest.mark.parametrize("n", [0, 1, 7, 64, 65, 5000])
def test_places_are_a_permutation(n):
    keys = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
    made = line_dedup.PerfectHash.build(np.unique(keys))
    again = line_dedup.PerfectHash.unpacked(*made.packed())
    assert sorted(again.places(keys).tolist()) == list(range(n))
