"""A corpus from raw documents: toxic documents go, repeated lines go, one document of each group of near copies stays, documents
that hold benchmark text go, and the rest is encoded.

Defined cases: a row with a null id or text, or without words, passes every stage (its ids are null where its text is), unless its text
is toxic, holds benchmark text, or loses all its lines to others; rows that share an id are one document for lines and near copies, and
are judged row by row elsewhere; of lines and near copies that are alike the one with the least id stays; texts of any length are
read whole; columns of any name stay as they are up to the last stage, n_chars follows the text; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontaminate, jaccard, line_dedup, pieces, toxicity
from graphloom.session import removed, written


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.rewritten(docs, drop_emptied=True)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_first(docs)


def benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encoded(docs)


STAGES = [("toxicity", toxic), ("line_dedup", repeated_lines), ("jaccard_join", near_copies), ("decontamination", benchmark_text), ("pieces", encoding)]

#: A trained model, minhash search and alignment have no SQL; the tests hold the whole against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs, folder = written(docs, f"stage-{name}")
            if before:
                removed(spark, before)
            before = folder
    return docs
