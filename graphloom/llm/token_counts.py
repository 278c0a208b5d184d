"""Token counts of flat, unindexed token files by a scan for separators.

A file is nothing but token ids, each document closed by the end-of-document id. Files are cut into blocks of equal size without
looking at them; every block is searched by one vectorised comparison and gives the lengths between its separators: the first one
belongs to a document that began earlier, the last one to a document that goes on. A prefix sum of the separators over the blocks of
a file numbers the documents; it runs over one row a block, without the lengths. Only the first and last length of a block are
added up by number, however many blocks a document crosses; all others are whole documents.

The width of an id follows from the size of the vocabulary, the end-of-document id is the model's end-of-sentence id, which no text
encodes to.

Defined cases: a null or empty text is a document of no tokens; ids after the last separator of a file are one more document, marked
as open; an empty file has no document; a text of any length, longer than a block too, is counted whole; an id that doesn't fit the
width is an error; null and repeated doc_ids are kept as they are; other columns are ignored. A file whose
size is no whole number of ids is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import removed, scratch_path, written
from .arrays import chunks
from .files import Writing, opened
from .pieces import Encoder

BLOCK = 8 << 20


def width_of(size: int) -> str:
    """The type of an id of a vocabulary of so many pieces."""
    return "<u2" if size <= 1 << 16 else "<u4"


def packed(ids: np.ndarray, counts: np.ndarray, eod: int, dtype: str) -> np.ndarray:
    """Ids of documents one after the other, each closed by eod."""
    most = np.iinfo(dtype).max
    if eod > most or len(ids) and (int(ids.max()) > most or int(ids.min()) < 0):
        raise ValueError(f"an id doesn't fit {dtype}")
    tokens = np.full(len(ids) + len(counts), eod, dtype)
    mask = np.ones(len(tokens), bool)
    mask[np.cumsum(counts + 1) - 1] = False
    tokens[mask] = ids
    return tokens


def write_tokens(docs: DataFrame, folder: str, encoder: Encoder, eod: int, dtype: str) -> DataFrame:
    """Encode documents into one flat file a task; (path, first, ids, bytes) says which documents a file holds, in order. The frame
    must be written once; a task that runs again writes the same file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, first = f"{folder}/tokens-{TaskContext.get().partitionId():06d}.bin", 0
        with Writing(path) as out:
            for batch in batches:
                for part in chunks(batch, "text"):
                    ids, counts = encoder.encode(part.column("text").to_pylist())
                    tokens = packed(ids, counts, eod, dtype)
                    out.write(tokens.tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([first], pa.int64()), pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([tokens.nbytes], pa.int64())], ["path", "first", "ids", "bytes"])
                    first += part.num_rows

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "path string, first long, ids array<long>, bytes long")


def scan(files: DataFrame, eod: int, dtype: str, block: int = BLOCK, folders: list[str] | None = None) -> DataFrame:
    """(path, ordinal, n_tokens, open) of every document in the files (path, bytes). `folders` gets the scratch table that is read."""
    width = np.dtype(dtype).itemsize
    step = max(1, block // width) * width

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at, total in zip(*(batch.column(k).to_pylist() for k in ("path", "at", "bytes"))):
                if total % width:
                    raise ValueError(f"{path}: {total} bytes are no whole number of ids")
                with opened(path) as f:
                    f.seek(at)
                    tokens = np.frombuffer(f.read(min(step, total - at)), dtype)
                hit = np.flatnonzero(tokens == eod)
                lengths = np.diff(np.concatenate([[-1], hit, [len(tokens)]])) - 1
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([at], pa.int64()), pa.array([len(hit)], pa.int64()), pa.array([lengths], pa.list_(pa.int64()))], ["path", "at", "n", "lengths"])

    spread = files.sparkSession.sparkContext.defaultParallelism * 4
    blocks = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(step).cast("long"))).alias("at"))
    # two plans read what is found: the numbers of separators and the lengths
    found, lengths = written(blocks.repartition(spread, "path", "at").mapInArrow(search, "path string, at long, n long, lengths array<long>"), "token-blocks")
    if folders is not None:
        folders.append(lengths)
    by = Window.partitionBy("path")
    before = F.coalesce(F.sum("n").over(by.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbers = found.select("path", "at", "n").withColumn("before", before).withColumn("total", F.sum("n").over(by)).drop("n")
    pieces = found.join(numbers, ["path", "at"]).select("path", "n", "before", "total", F.posexplode("lengths").alias("k", "n_tokens")).withColumn("ordinal", F.col("before") + F.col("k"))
    inner = pieces.where("k > 0 and k < n").select("path", "ordinal", "n_tokens", F.lit(False).alias("open"))
    crossing = pieces.where("k = 0 or k = n").groupBy("path", "ordinal").agg(F.sum("n_tokens").alias("n_tokens"), F.first("total").alias("total"))
    return inner.unionByName(crossing.where("ordinal < total or n_tokens > 0").select("path", "ordinal", "n_tokens", (F.col("ordinal") >= F.col("total")).alias("open")))


def document_counts(docs: DataFrame, encoder: Encoder | None = None, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_tokens): documents written as flat files, and counted by scanning these."""
    spark, encoder = docs.sparkSession, encoder or Encoder()
    size, eod = encoder.ready().size, encoder.ready().eod
    folder = scratch_path(spark, "tokens")
    folders = [folder]
    manifest, listed = written(write_tokens(docs, folder, encoder, eod, width_of(size)), "token-files")
    counts = scan(manifest.groupBy("path").agg(F.sum("bytes").alias("bytes")), eod, width_of(size), block, folders)
    names = manifest.select("path", "first", F.posexplode("ids").alias("k", "doc_id")).select("path", (F.col("first") + F.col("k")).alias("ordinal"), "doc_id")
    # as large as each other, though the manifest is small as a file: neither is to be broadcast
    joined = names.hint("merge").join(counts, ["path", "ordinal"], "left").select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))
    out, _ = written(joined, "token-counts")
    for path in (*folders, listed):
        removed(spark, path)
    return out
