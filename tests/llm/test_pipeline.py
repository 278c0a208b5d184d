import random

import pytest
import sentencepiece

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from graphloom.llm import decontaminate, jaccard, line_dedup, pieces, toxicity  # noqa: E402
from graphloom.llm.queries import queries  # noqa: E402

from .test_decontaminate import budget, folded, least_edits, prose, windows  # noqa: E402
from .test_jaccard import grouped  # noqa: E402
from .util import rows  # noqa: E402


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs.persist()]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], sf_dir).persist())
    return out


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "decontamination", "pieces"]
    assert [int(n[2:].split("_")[0]) for n in queries() if n.startswith("op")] == list(range(1, 11))


def test_all_but_the_last_keep_the_columns(steps):
    assert all(df.dtypes == steps[0].dtypes for df in steps[:-1])


def test_decisions_take_effect(spark, sf_dir, steps):
    """Each stage against what its operator says of the stage's own input."""
    labels, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = [sorted(r.doc_id for r in df.select("doc_id").collect()) for df in steps]
    toxic = {r.doc_id for r in toxicity.scores(steps[0], labels).where("toxic").collect()}
    assert ids[1] == [k for k in ids[0] if k not in toxic]
    texts = {r.doc_id: r.text for r in line_dedup.rewritten(steps[1], drop_emptied=True).collect()}
    assert {r.doc_id: r.text for r in steps[2].collect()} == texts
    first = {r.doc_id: r.class_id for r in jaccard.classes(steps[2]).collect()}
    assert ids[3] == [k for k in ids[2] if first[k] == k]
    leaked = {r.doc_id for r in decontaminate.matches(steps[3], benchmark).collect()}
    assert leaked and ids[4] == [k for k in ids[3] if k not in leaked]
    assert sorted(rows(steps[5])) == sorted(rows(pieces.encoded(steps[4])))


def test_run_is_the_stages_in_a_row(spark, sf_dir, steps):
    assert sorted(rows(corpus_pipeline.run(spark, sf_dir))) == sorted(rows(steps[-1]))


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.collect() == []
        if "text" not in docs.columns:
            break


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder of small tables with all that the stages look for, and rows of every odd kind; (folder, documents)."""
    rng, folder = random.Random(8), tmp_path_factory.mktemp("small")
    items = [(k, prose(rng, 30)) for k in range(3)]
    line = "a line that many documents share, and that one of them owns"
    docs = [(k, f"{prose(rng, 60)}\n{prose(rng, 20)}") for k in range(40)]
    docs += [(100 + k, f"{prose(rng, 40)} you {bad} {prose(rng, 40)}") for k, bad in enumerate(["stupid idiot", "stup1d idiot", "s.t.u.p.i.d idiot", "$tupid 1d1ot", "stupid"] * 6)]
    docs += [(200 + k, f"{prose(rng, 50)}\n{line}\n{prose(rng, 50)}") for k in range(5)]
    docs += [(300 + k, docs[k][1]) for k in range(3)] + [(310 + k, docs[5 + k][1].replace(" ", " uh ", 2 + k)) for k in range(3)]
    docs += [(400, f"{prose(rng, 30)} {items[0][1]} {prose(rng, 30)}"), (401, f"{prose(rng, 30)} {items[1][1][:50]}q{items[1][1][51:]} {prose(rng, 30)}")]
    docs += [(500, None), (501, ""), (502, "  \n "), (503, line), (504, "word " * 30_000), (505, "one row"), (505, "one row"), (None, f"{prose(rng, 30)} without an id")]
    rows_ = [(k, x, "en", "s", None if x is None else len(x), "x", 1) for k, x in docs]
    spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars long, gone string, id int").write.parquet(f"{folder}/documents.parquet")
    labels = [(k, 1, int(100 <= k < 200)) for k, _ in docs if k is not None and k < 200 and k % 5 != 4] + [(None, 1, 1), (3, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([*items, (9, None), (10, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), docs, items


def plainly(docs, items):
    """The stages one after the other, in plain Python."""
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    docs = [(k, t) for k, t in docs if not (k is not None and 100 <= k < 200)]
    owner, out = {}, []
    for k, t in docs:
        for x in (t or "").split("\n"):
            owner[x] = min(owner.get(x, line_dedup.LAST), line_dedup.LAST if k is None else k)
    for k, t in docs:
        seen, kept = set(), []
        for x in (t or "").split("\n"):
            if len(x.encode()) >= 20 and (owner[x] != (line_dedup.LAST if k is None else k) or x in seen):
                continue
            seen.add(x)
            kept.append(x)
        if t is None or any(kept) or "\n".join(kept) == t:
            out.append((k, None if t is None else "\n".join(kept)))
    first = {k: v[0] for k, v in grouped(out, 0.5).items()}
    out = [(k, t) for k, t in out if k is None or first[k] == k]
    s = decontaminate.Settings()
    exact = [(i, folded(x).strip()) for i, x in items]
    held = {k for k, t in out for _, x in exact if len(t or "") < 5000 and any(least_edits(w, folded(t)) <= budget(w, s) for w in windows(x.decode(), s))}
    return sorted(((k, None if t is None else library.encode(t)) for k, t in out if k not in held), key=str)


def test_against_plain_python(spark, small):
    folder, docs, items = small
    got = corpus_pipeline.run(spark, folder).select("doc_id", "ids").collect()
    assert sorted(((r.doc_id, r.ids) for r in got), key=str) == plainly(docs, items)


def test_columns_of_any_name_stay(spark, small):
    docs = spark.read.parquet(f"{small[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs, was = stage(spark, docs, small[0]).persist(), docs
        assert docs.dtypes == was.dtypes and docs.where("gone <> 'x' or id <> 1").count() == 0
