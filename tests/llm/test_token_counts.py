import numpy as np
import pytest
import sentencepiece
from pyspark.errors import PySparkException

from graphloom.llm import pieces, token_counts as tc

from .util import ODD, rows, table


EOD, DTYPE = 2, "<u2"


def files(spark, tmp_path, contents):
    made = []
    for k, tokens in enumerate(contents):
        np.array(tokens, DTYPE).tofile(tmp_path / f"{k}.bin")
        made.append((str(tmp_path / f"{k}.bin"), 2 * len(tokens)))
    return spark.createDataFrame(made, "path string, bytes long")


def brute(tokens):
    out, n = [], 0
    for t in tokens:
        if t == EOD:
            out.append((n, False))
            n = 0
        else:
            n += 1
    return out + ([(n, True)] if n else [])


@pytest.mark.parametrize("block", [2, 4, 6, 10, 64, 1 << 20])
def test_blocks_are_stitched(spark, tmp_path, block):
    rng = np.random.default_rng(1)
    contents = [rng.choice([2, 5, 6, 7], 200), [2, 2, 2], [5] * 50, [], [5, 2], rng.choice([2, 5], 99)]
    got = tc.scan(files(spark, tmp_path, contents), EOD, DTYPE, block).collect()
    for k, tokens in enumerate(contents):
        mine = sorted((r.ordinal, r.n_tokens, r.open) for r in got if r.path.endswith(f"/{k}.bin"))
        assert mine == [(i, *x) for i, x in enumerate(brute(tokens))]


def test_a_broken_size_is_an_error(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    with pytest.raises(PySparkException):
        tc.scan(spark.createDataFrame([(str(tmp_path / "x.bin"), 3)], "path string, bytes long"), EOD, DTYPE).collect()


@pytest.mark.parametrize("block", [1000, tc.BLOCK])
def test_counts_of_the_table(spark, sf_dir, block):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    want = sorted((r.doc_id, len(library.encode(r.text or ""))) for r in docs.collect())
    assert sorted(rows(tc.document_counts(docs, block=block))) == want


def test_odd_rows(spark):
    got = sorted(rows(tc.document_counts(table(spark, ODD))), key=lambda r: (r[0] is None, r))
    assert len(got) == len(ODD) and got[:2] == [(1, 0), (2, 0)] and got[-1][0] is None
    assert got[4] == got[5] or got[5] == got[6]
    assert rows(tc.document_counts(table(spark, []))) == []


def test_ids_beyond_the_width_are_wide_or_an_error(spark, tmp_path):
    assert (tc.width_of(65_536), tc.width_of(65_537)) == ("<u2", "<u4")
    ids, counts = np.array([70_000, 65_538, 5]), np.array([2, 0, 1])
    assert tc.packed(ids, counts, 2, "<u4").tolist() == [70_000, 65_538, 2, 2, 5, 2]
    with pytest.raises(ValueError):
        tc.packed(ids, counts, 2, "<u2")
    tc.packed(ids, counts, 2, "<u4").tofile(tmp_path / "wide.bin")
    got = tc.scan(spark.createDataFrame([(str(tmp_path / "wide.bin"), 24)], "path string, bytes long"), 2, "<u4", 8).collect()
    assert sorted((r.ordinal, r.n_tokens, r.open) for r in got) == [(0, 2, False), (1, 0, False), (2, 1, False)]


def test_other_columns_with_the_names_used_inside(spark):
    docs = table(spark, [(1, "one"), (1, "one"), (2, None)]).withColumnsRenamed({"lang": "ordinal", "source": "n_tokens", "doc": "first"})
    got = tc.document_counts(docs)
    assert got.columns == ["doc_id", "n_tokens"] and sorted(rows(got)) == [(1, 1), (1, 1), (2, 0)]
