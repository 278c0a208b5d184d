import itertools

import numpy as np
import pytest

from graphloom.llm import toxicity as tx

from .util import ODD, rows, table

CLEAN = "the garden is green and the river runs slowly to the sea while people walk home for bread and tea"
BAD = ["stupid idiots", "such an idiot", "what stupid people", "idiot and stupid", "that idiot again", "stupid idiot"]


@pytest.fixture(scope="module")
def small(spark):
    docs = [(k, CLEAN) for k in range(40)] + [(100 + k, f"{CLEAN[: 40 + k]} {BAD[k % 6]} stupid") for k in range(40)]
    labels = spark.createDataFrame([(k, int(k >= 100), "x") for k, _ in docs] + [(None, 1, "x"), (7, None, "x")], "doc_id long, toxic int, text string")
    return table(spark, docs), labels


def brute(text, model, s, spaced=False):
    """The best reading by trying them all."""
    parts, best = [list(g) for _, g in itertools.groupby(text)], None
    options = []
    bounds = [set(p) <= set(tx._BOUND) for p in parts]
    for k, p in enumerate(parts):
        c, run = p[0], len(p)
        if c in tx.GAP:
            options.append([(" ", s.keep), ("", 0.0)] if spaced else [(" ", 0.0), ("", s.drop)])
        elif "a" <= c <= "z":
            options.append([(c * run, 0.0)] if run < 3 else [(c, s.more), (c * 2, s.more)])
        else:
            edge = [(" ", 0.0)] if all(bounds[: k + 1]) or all(bounds[k:]) else []
            options.append([(c * run, 0.0)] + edge + [(x * n, s.swap) for x in tx.LEET.get(c, "") for n in ([1, 2] if run > 1 else [1])])
    for arcs in itertools.product(*options):
        at, total = 0, 0.0
        for emit, cost in arcs:
            total += cost
            for e in emit:
                code = tx._CODE.get(e, tx.OTHER)
                if code or at & 31:
                    at = at << 5 | code
                    total += model[at]
                    at &= 0x7FFF
        total += model[at << 5] if at & 31 else 0.0
        if best is None or total > best[0] + 1e-9:
            best = (total, "".join(e for e, _ in arcs))
    return best[1]


@pytest.mark.parametrize("text, spaced", [("st00pid", False), ("1d10t", False), ("i.d.i.o.t", False), ("stuuuupid", False), ("$tup1d", False), ("s t u p i d", True), ("g4rden", False), ("(stup1d!", False), ("!d!ot!!", False), ("57|_|p1d", False), ("!|(", False), ("77777777777d", False), ("1d!07|", False)])
def test_viterbi_finds_the_best_reading(small, text, spaced):
    s, model = tx.Settings(), tx.character_model(small[0])
    assert tx.Restorer(model, s).decode(text, spaced) == brute(text, model.tolist(), s, spaced)


@pytest.fixture(scope="module")
def reader(spark):
    """A model of words and of numbers."""
    docs = table(spark, [(k, f"that unit sits in an ass and a class of cats, {CLEAN} since {1990 + k} for {k * 37} men") for k in range(60)])
    return tx.Restorer(tx.character_model(docs), tx.Settings())


@pytest.mark.parametrize("raw, words", [("4$$", "ass"), ("@$$", "ass"), ("$|7", "sit"), ("(@7$", "cats"), ("1995", "1995"), ("(1995)", "1995"), ("(the", "the"), ("tea!!", "tea"), ("!!!", ""), ("--", ""), ("370,", "370"), ("$" * 5000, "$" * 5000), ("(@75", "cats"), ("|/|", "|/|")])
def test_tokens_without_letters_span_a_lattice(reader, raw, words):
    best, changed = reader.token(raw)
    if raw == "|/|":
        assert not any(c.isalpha() for c in best) or changed
    elif raw[:9] == "$" * 9:
        assert best in ("$" * 5000, "s", "ss")
    else:
        assert best.strip("!|(") == words and changed == (words.isalpha() and words not in raw)


def test_long_runs_are_scored_whole(reader):
    """A run of one character costs what its characters cost one by one."""
    model = reader.model.tolist()
    for text in ("5" * 9 + "a", "a" + "!" * 7 + "b", "$" * 6):
        assert reader.decode(text) == brute(text, model, reader.s)


def test_character_counts_are_whole(small):
    got = {r.gram: r.n for r in tx.character_counts(small[0]).collect()}
    the = 20 << 15 | 8 << 10 | 5 << 5  # "the" and a gap
    assert got[the] == sum(r.text.split().count("the") for r in small[0].collect())


def test_hidden_words_are_judged_like_plain_ones(spark, small):
    docs, labels = small
    judge = tx.judge(docs, labels)
    for text in ("you stupid idiots", "you stup1d 1d1ots", "you s.t.u.p.i.d idiots", "you s t u p i d person", "you stuuuuupid"):
        assert judge.score(text, " t u " in text)[0] > 0, text
    assert judge.score("the green garden", False)[0] < 0
    assert judge.score("you $tup1d garden", False) == (judge.score("you stupid garden", False)[0], 1, "you stupid garden")


def test_held_out_accuracy(spark):
    """Fitted on half of the labels, right on the other half."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = {r.doc_id: r.toxic for r in tx.scores(docs, labels.where("pmod(hash(doc_id), 2) = 0")).collect()}
    assert len(got) == docs.count()
    rest = [(bool(r.toxic), got[r.doc_id]) for r in labels.where("pmod(hash(doc_id), 2) = 1 and toxic is not null").collect() if r.doc_id in got]
    bad, good = [g for y, g in rest if y], [g for y, g in rest if not y]
    assert np.mean(bad) >= 0.9 and np.mean(good) <= 0.02


def test_clean_keeps_what_scores_keep(small):
    docs, labels = small
    toxic = {r.doc_id for r in tx.scores(docs, labels).where("toxic").collect()}
    assert toxic == set(range(100, 140))
    kept = tx.clean(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(40))


def test_odd_rows(spark, small):
    _, labels = small
    odd = table(spark, ODD)
    got = rows(tx.scores(odd, labels))
    assert len(got) == len(ODD) and not any(r[2] for r in got)
    assert tx.clean(odd, labels).count() == len(ODD)
    assert not any(r[2] for r in rows(tx.scores(small[0], labels.where("toxic = 0"))))
    assert rows(tx.scores(table(spark, []), labels)) == [] == rows(tx.clean(table(spark, []), labels.where("false")))
