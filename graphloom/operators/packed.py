"""Graphs as flat arrays in the shared folder, for loops with many short rounds.

Vertices are numbered from 0; edges (s, t, w) lie in files by ranges of one end, some EDGES of them in each. A task reads the files it
needs through Arrow's file systems, so neither edges nor what belongs to them passes through the driver. What is held of a graph grows
with it, so callers state a bound and have another way beyond it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import removed, renewed, scratch_path
from .statistics import ranked

EDGES = 250_000
A = TypeVar("A")
B = TypeVar("B")


def _system(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def save(uri: str, *arrays: np.ndarray) -> None:
    """Arrays one after the other in a file, which appears when it is whole; a task that runs twice leaves one file."""
    system, path = _system(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    temporary = f"{path}.{np.random.default_rng().integers(1 << 62):x}.tmp"
    with system.open_output_stream(temporary, compression=None) as out:
        for a in arrays:
            out.write(np.ascontiguousarray(a).data)
    system.move(temporary, path)


def load(uri: str) -> memoryview:
    system, path = _system(uri)
    with system.open_input_file(path) as f:
        return memoryview(f.readall())


_kept: dict[str, object] = {}


def kept(uri: str, make: Callable[[], A]) -> A:
    """What was made of a file last stays in a worker, for its next tasks."""
    if uri not in _kept:
        _kept.clear()
        _kept[uri] = make()
    return _kept[uri]


def numbered(*ids: DataFrame) -> DataFrame:
    """(id, n): numbers from 0 over the ids of all frames (lot, id), in the order of the lots, those of the first frame first."""
    rows = ids[0].select("lot", "id", F.lit(0).alias("place"))
    for k, more in enumerate(ids[1:], 1):
        rows = rows.unionByName(more.select("lot", "id", F.lit(k).alias("place")))
    return renewed(ranked(rows.withColumn("lot", F.struct("place", "lot")), "lot").select("id", F.col("rank").alias("n")))


@dataclass(frozen=True)
class Files:
    """Edges in files. A file holds numbers s and t as int32 and weights w as int64, in this order."""

    folder: str
    counts: tuple[int, ...]
    vertices: int
    heaviest: int

    @property
    def edges(self) -> int:
        return sum(self.counts)

    def read(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data, n = load(f"{self.folder}/{k}"), self.counts[k]
        return np.frombuffer(data, np.int32, n), np.frombuffer(data, np.int32, n, 4 * n), np.frombuffer(data, np.int64, n, 8 * n)


def packed(edges: DataFrame, vertices: int, by: tuple[str, ...], count: int) -> Files:
    """The edges (s, t, w), of which there are `count`, in files by ranges of the columns `by` and ordered by them."""
    spark = edges.sparkSession
    folder = scratch_path(spark, "edges")
    parts = max(1, -(-count // EDGES))
    placed = edges.select(F.col("s").cast("int"), F.col("t").cast("int"), F.col("w").cast("long")).repartitionByRange(parts, *by)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [[b.column(c).to_numpy() for c in ("s", "t", "w", "part")] for b in batches if len(b)]
        if rows:
            s, t, w, part = (np.concatenate(c) for c in zip(*rows))
            save(f"{folder}/part-{part[0]}", s, t, w)
            yield pa.RecordBatch.from_pydict({"part": pa.array(part[:1], pa.int32()), "n": pa.array([len(s)], pa.int64()), "most": pa.array([w.max()], pa.int64())})

    found = placed.withColumn("part", F.spark_partition_id()).sortWithinPartitions(*by).mapInArrow(write, "part int, n long, most long").collect()  # a row for each file
    system, path = _system(folder)
    for k, r in enumerate(sorted(found)):
        system.move(f"{path}/part-{r.part}", f"{path}/{k}")
    return Files(folder, tuple(r.n for r in sorted(found)), vertices, max((r.most for r in found), default=0))


def dropped(spark: SparkSession, files: Files) -> None:
    removed(spark, files.folder)


def over(spark: SparkSession, items: Iterable[A], work: Callable[[A], B]) -> list[B]:
    """What a function gives for each item, a task each."""
    found = list(items)
    return spark.sparkContext.parallelize(found, len(found)).map(work).collect() if found else []


def looked_up(batches: Iterator[pa.RecordBatch], values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(n, x): numbers of vertices and their values."""
    for b in batches:
        n = b.column("n").to_numpy()
        yield pa.RecordBatch.from_pydict({"n": b.column("n"), "x": pa.array(values[n])})


@dataclass
class Rows:
    """A graph's edges by source: those of s are t[start[s] : start[s + 1]] with weights w."""

    start: np.ndarray
    t: np.ndarray
    w: np.ndarray

    @classmethod
    def of(cls, files: Files) -> Rows:
        total = files.edges
        degree = np.zeros(files.vertices + 1, np.int64)
        t, w = np.empty(total, np.int32), np.empty(total, np.int32 if files.heaviest < 2**31 else np.int64)
        at = 0
        for k, n in enumerate(files.counts):
            s, t[at : at + n], w[at : at + n] = files.read(k)
            if n:  # a file has the sources of a range
                low = int(s[0])
                here = np.bincount(s - low)
                degree[low + 1 : low + 1 + len(here)] += here
            at += n
        return cls(np.cumsum(degree), t, w)
