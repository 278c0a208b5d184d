"""Small tables with what may be hard in them."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, doc string, gone int, id string, path string"


def table(spark, rows):
    """Documents out of (doc_id, text), with further columns whose names may clash with those of an operator."""
    return spark.createDataFrame([(k, t, "en", "s", None if t is None else len(t), "x", 1, "y", "z") for k, t in rows], DOCS)


def rows(df):
    return [tuple(r) for r in df.collect()]


ODD = [(1, None), (2, ""), (3, "   \n \n"), (None, "a text without an id stands here"), (4, "word " * 30_000), (5, "same text twice over here"), (5, "same text twice over here"), (6, "zażółć gęślą jaźń 語 🙂  x")]
