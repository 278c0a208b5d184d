import itertools
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import hmm

from .util import ODD, rows, table

S = hmm.Settings(states=2, rounds=3, least=1, shard_words=4)
TEXTS = [(1, "the cat sat\nthe dog sat"), (2, "A dog ran. the cat ran"), (3, "cat"), (4, "the the the unseen")]


def summed_over_paths(text, model, s):
    """The likelihood as a sum over all state sequences."""
    q = hmm.Sequences(pa.array([text]))
    b, _ = hmm.Emissions(model, s).of(q.words)
    total = 0.0
    for r, _ in q.runs(7):
        for k in range(int(r.active[0])):
            word = [r.word[r.edge[t] + k] for t, n in enumerate(r.active) if k < n]
            p = 0.0
            for path in itertools.product(range(s.states), repeat=len(word)):
                x = model.start[path[0]]
                for t, (w, z) in enumerate(zip(word, path)):
                    x *= (model.move[path[t - 1], z] if t else 1) * b[w, z]
                p += x
            total += math.log(p)
    return total


def test_likelihood_is_exact(spark):
    docs = table(spark, TEXTS)
    model, curve = hmm.trained(docs, S)
    got = {r[0]: r for r in rows(hmm.scores(docs, model, S))}
    for k, t in TEXTS:
        assert got[k][2] == pytest.approx(summed_over_paths(t, model, S), rel=1e-9)
        assert got[k][3] == pytest.approx(math.exp(-got[k][2] / got[k][1]))
    assert [got[k][1] for k in (1, 2, 3, 4)] == [6, 6, 1, 4]
    assert all(b >= a - 0.5 for a, b in zip(curve, curve[1:]))


def test_counts_are_expected_states(spark):
    """Counts by word add up to how often the word stands there; the first states to the number of sequences."""
    sequences = hmm.encoded(table(spark, TEXTS))
    for shards in (1, 4):
        got = hmm.expected_counts(sequences, hmm.initial(S), S, shards).collect()
        by = {}
        for r in got:
            if r.shard != hmm.REST:
                for h, c in zip(np.frombuffer(r.h, np.uint64).tolist(), np.frombuffer(r.c, np.float32).reshape(-1, 2).sum(1).tolist()):
                    assert shards == 1 or h >> 62 == r.shard
                    by[h] = by.get(h, 0) + c
        assert sorted(round(x, 5) for x in by.values()) == [1, 1, 2, 2, 2, 3, 6]  # a, unseen; dog, ran, sat; cat; the
        rest = sum(np.frombuffer(r.c) for r in got if r.shard == hmm.REST)
        assert rest[:4].sum() == pytest.approx(17 - 5) and rest[4:6].sum() == pytest.approx(5) and rest[7] == 17


def em(texts, s, rounds):
    """Baum-Welch by state paths one by one, over sequences of words as they stand; the log likelihood before each round."""
    import re

    sequences = [w for t in texts for line in t.lower().split("\n") if (w := re.findall("[0-9a-z]+", line))]
    hashed = {}
    for w in {w for x in sequences for w in x}:
        hashed[w] = hmm.Sequences(pa.array([w])).words
    m, curve = hmm.initial(s), []
    emit = {w: hmm.Emissions(m, s).of(h)[0][0] for w, h in hashed.items()}
    for _ in range(rounds):
        moves, first, counts, total = np.zeros((s.states, s.states)), np.zeros(s.states), {w: np.zeros(s.states) for w in hashed}, 0.0
        for x in sequences:
            paths = list(itertools.product(range(s.states), repeat=len(x)))
            p = np.array([m.start[z[0]] * np.prod([emit[w][k] for w, k in zip(x, z)]) * np.prod([m.move[a, b] for a, b in zip(z, z[1:])]) for z in paths])
            total += math.log(p.sum())
            for z, share in zip(paths, p / p.sum()):
                first[z[0]] += share
                for w, k in zip(x, z):
                    counts[w][k] += share
                for a, b in zip(z, z[1:]):
                    moves[a, b] += share
        curve.append(total)
        move = moves + s.smoothing
        m = hmm.Model((first + s.smoothing) / (first + s.smoothing).sum(), move / move.sum(1, keepdims=True))
        totals = sum(counts.values())
        emit = {w: (c + s.smoothing) / (totals + s.smoothing * (len(hashed) + 1)) for w, c in counts.items()}
    return m, curve


def test_training_is_baum_welch(spark):
    """Rounds over the table against expected counts that are summed over all state paths."""
    model, curve = hmm.trained(table(spark, TEXTS), hmm.Settings(states=2, rounds=4, least=1, shard_words=2))
    m, want = em([t for _, t in TEXTS], hmm.Settings(states=2), 4)
    assert curve == pytest.approx(want, rel=1e-5)
    assert np.allclose(model.move, m.move, rtol=1e-4) and np.allclose(model.start, m.start, rtol=1e-4)


def test_shards_beyond_the_memory_bound_give_the_same(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a = hmm.Settings(states=3, rounds=2, shard_words=20_000)
    b = hmm.Settings(states=3, rounds=2, shard_words=20_000, held_bytes=1)
    x, y = (np.array([r[2] for r in hmm.corpus_scores(docs, s).orderBy("doc_id").collect()]) for s in (a, b))
    assert len(x) == docs.count() and np.allclose(x, y, rtol=1e-6)


def test_training_raises_the_likelihood(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    _, curve = hmm.trained(docs, hmm.Settings(rounds=4))
    assert curve[3] > curve[2] > curve[1]  # the first is that of emissions that are no probabilities


def test_training_goes_on_until_it_gains_little_and_beats_the_unigram_model(spark):
    docs, s = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), hmm.Settings()
    model, curve = hmm.trained(docs, s)
    gains = [(b - a) / model.tokens for a, b in zip(curve[1:], curve[2:])]
    assert gains[-1] < s.tolerance <= min(gains[:-1])
    q = hmm.Sequences(docs.select("text").toArrow()["text"].combine_chunks())
    n = np.bincount(q.word).astype(float)
    rare = n < s.least
    n[rare] = n[rare].sum()
    unigram = np.log((n + s.smoothing) / (len(q.word) + s.smoothing * ((~rare).sum() + 1)))[q.word].mean()
    got = hmm.scores(docs, model, s).agg(F.sum("log_likelihood"), F.sum("n_tokens")).head()
    print("rounds", len(curve), "unigram", -unigram, "model", -got[0] / got[1])
    assert got[1] == len(q.word) and got[0] / got[1] > unigram + 0.5


def test_odd_rows(spark):
    got = sorted(rows(hmm.corpus_scores(table(spark, ODD), hmm.Settings(rounds=2))), key=lambda r: (r[0] is None, r[0] or 0))
    assert len(got) == len(ODD)
    assert [r[1:] for r in got[:3]] == [(0, 0.0, None)] * 3
    assert got[-1][0] is None and got[-1][1] == 7
    assert next(r for r in got if r[0] == 4)[1] == 30_000
    twice = [r for r in got if r[0] == 5]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert rows(hmm.corpus_scores(table(spark, []))) == []
