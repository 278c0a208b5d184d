import itertools
import random
import struct

import numpy as np
import pytest
import sentencepiece

from graphloom.llm import pieces

from .util import ODD, rows, table

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def check(spark, texts):
    got = {r.doc_id: r for r in pieces.encoded(table(spark, list(enumerate(texts)))).collect()}
    for k, t in enumerate(texts):
        assert got[k].ids == LIBRARY.encode(t), t[:80]
        assert got[k].n_tokens == len(got[k].ids)
    return got


def test_like_the_library(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if r.text]
    got = check(spark, texts)
    assert sum(r.round_trip for r in got.values()) >= 0.99 * len(texts)


def test_hard_texts(spark):
    rng = random.Random(2)
    alphabet = "abcehilnorst  \n\t.,'0129éß語🙂▁"
    check(spark, ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(300)] + ["x" * 3000, " lead", "trail ", "  two", "a  b", "\n", " "])


def _message(fields):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += varint(number << 3) + varint(value)
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


@pytest.fixture(scope="module")
def as_unigram():
    """The library with the same vocabulary as a unigram model."""
    with open(pieces.MODEL, "rb") as f:
        raw = f.read()
    known, kind = pieces.read_model(raw)
    assert kind == pieces.BPE
    spec = dict(pieces._fields(next(v for n, v in pieces._fields(raw) if n == 2)))
    keep = {k: v for k, v in spec.items() if k in (35, 40, 41, 42, 43)} | {3: pieces.UNIGRAM}
    parts = [(1, _message([(1, p.encode()), (2, pieces.rank_score(k)), (3, kind)])) for k, (p, _, kind) in enumerate(known)]
    rest = [(n, v) for n, v in pieces._fields(raw) if n not in (1, 2)]
    return sentencepiece.SentencePieceProcessor(model_proto=_message([*parts, (2, _message(sorted(keep.items()))), *rest]))


def test_viterbi_is_like_the_library_with_a_unigram_model(spark, sf_dir, as_unigram):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if r.text] + ["x" * 500, "語🙂 ab", "a  b\n\nc", " "]
    got = {r.doc_id: r for r in pieces.encoded(table(spark, list(enumerate(texts))), pieces.Encoder(by_rank=True)).collect()}
    wrong = [t for k, t in enumerate(texts) if got[k].ids != as_unigram.encode(t)]
    assert not wrong, wrong[0][:200]


def test_unigram_is_the_best_segmentation():
    rng = random.Random(4)
    parts = {c: -5.0 for c in "abc"} | {"".join(rng.choice("abc") for _ in range(n)): -rng.uniform(4, 9) for n in (2, 2, 3, 3, 4) for _ in range(3)}
    v = pieces.Vocabulary(list(parts.items()), bpe=False)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(200)})
    for word, ids in zip(words, v.encode_sorted(words)):
        best = -1e9
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            at = [0, *(k + 1 for k, c in enumerate(cuts) if c), len(word)]
            seg = [word[a:b] for a, b in zip(at, at[1:])]
            if all(s in parts for s in seg):
                best = max(best, sum(parts[s] for s in seg))
        assert "".join(v.names[k] for k in ids) == word
        assert sum(v.score[k] for k in ids) == pytest.approx(best)


def test_characters_without_a_piece():
    v = pieces.Vocabulary([("<unk>", 0.0), ("a", -1.0)], bpe=False, special=frozenset([0]))
    assert v.encode_sorted(["axa", "axxa"]) == [[1, 0, 1], [1, 0, 1]]


def test_the_kind_comes_from_the_model(tmp_path):
    """Whole numbers as scores don't make a model BPE; kinds and symbols that aren't handled are errors."""
    parts = [(1, _message([(1, p), (2, x), (3, kind)])) for p, x, kind in ((b"<unk>", 0.0, 2), (b"a", -1.0, 1), (b"aa", -3.0, 1))]
    for kind, ids in ((1, [1, 1]), (2, [2])):
        (tmp_path / "m").write_bytes(_message([*parts, (2, _message([(3, kind)]))]))
        assert pieces.Vocabulary.load(str(tmp_path / "m")).encode_sorted(["aa"]) == [ids]
    for extra, kind in (((b"<x>", 0.0, 4), 1), ((b"b", 0.0, 1), 3)):
        (tmp_path / "m").write_bytes(_message([*parts, (1, _message(list(zip((1, 2, 3), extra)))), (2, _message([(3, kind)]))]))
        with pytest.raises(ValueError):
            pieces.Vocabulary.load(str(tmp_path / "m"))


def test_decoding(spark):
    docs = table(spark, [(1, "Some text, with  spaces\nand lines."), (2, ""), (3, None), (4, "語🙂")])
    got = {r.doc_id: r.text for r in pieces.decoded(pieces.encoded(docs).withColumn("text", docs.doc_id * 0 if False else pieces.F.lit(1))).collect()}
    assert got == {1: "Some text, with  spaces\nand lines.", 2: "", 3: None, 4: "語🙂"}


def test_a_small_memory_gives_the_same():
    encoder = pieces.Encoder()
    encoder.most = 5
    texts = ["one two three four five six seven eight", None, "", "nine ten one two"]
    ids, counts = encoder.encode(texts)
    assert ids.tolist() == LIBRARY.encode(texts[0]) + LIBRARY.encode(texts[3])
    assert counts.tolist()[1:3] == [0, 0]
    assert np.array_equal(encoder.encode(texts)[0], ids)


def test_odd_rows(spark):
    got = rows(pieces.encoded(table(spark, ODD)))
    assert len(got) == len(ODD)
    by = {r[0]: r for r in got}
    assert by[1][1:] == (None, None, None) and by[2][1:] == ([], 0, True)
    assert by[4][1] == LIBRARY.encode(ODD[4][1])
    assert rows(pieces.encoded(table(spark, []))) == []
