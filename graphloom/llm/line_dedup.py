"""Line dedup over a sharded minimal perfect hash.

1. Every distinct line (64-bit hash) gets its count of documents and its owner, the smallest doc_id that has it.
2. The distinct hashes are cut into shards of about `shard_lines`. Each shard becomes a minimal perfect hash (levels of bit
   arrays; a key's place is the rank of its bit) over three flat arrays: a 32-bit fingerprint, a count and an owner for each line.
   The index is a table in the shared folder, one file a shard; no task holds more than one shard, whatever the corpus.
3. Documents send hashes of their lines (not the lines) to the shard, salted so that a line which stands everywhere is probed by
   many tasks. What comes back is the lines that a document doesn't own.
4. A line stays in the document that owns it, at its first place there, and goes everywhere else.

Defined cases: lines under `least` bytes, and empty ones, are never counted or removed; a null text stays null, an empty one
empty; documents with a null doc_id count as one document that comes last; rows that share a doc_id are one document, each row
keeps its first copy of what that document owns; a doc_id of 2^63 - 1 counts as null; `counter` may not be the name of a column; other columns stay as they are, and n_chars, if there, follows the text; empty
tables give empty results. Lines are told apart by a 64-bit hash of all their bytes between newlines, however long; of equal lines the one
that comes first stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import removed, written
from .arrays import chunks, flat, fresh, hashes, lines, mixed, signed
from .files import _system

LAST = 2**63 - 1  # stands for a null doc_id
_GAMMA = 1.5


@dataclass(frozen=True)
class Settings:
    least: int = 20  # bytes of the shortest line that is looked at
    shard_lines: int = 400_000
    salts: int = 16


class PerfectHash:
    """A minimal perfect hash: keys that are alone in their slot of a level set its bit, the others go on to the next."""

    def __init__(self, sizes: list[int], bits: list[np.ndarray]):
        self.sizes, self.bits = sizes, bits
        padded = [np.concatenate([b, np.zeros(-len(b) % 8, np.uint8)]) for b in bits]
        self.words = np.concatenate(padded).view(np.uint64) if bits else np.zeros(0, np.uint64)
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])  # of the first bit of each word
        self.base = np.concatenate([[0], np.cumsum([len(b) * 8 for b in padded])]).astype(np.int64)

    @staticmethod
    def slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """Over distinct keys."""
        sizes, bits, level = [], [], 0
        while len(keys):
            size = max(8, int(_GAMMA * len(keys)) + 1)
            at = cls.slots(keys, level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(np.packbits(alone, bitorder="little"))
            keys = keys[~alone[at]]
            level += 1
        return cls(sizes, bits)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; -1 for a key that ends at no bit (a foreign key may also get some place)."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = self.slots(keys[left], level, size) + self.base[level]
            word, bit = self.words[at >> 6], np.uint64(1) << (at & 63).astype(np.uint64)
            hit = (word & bit) > 0
            out[left[hit]] = self.rank[at[hit] >> 6] + np.bitwise_count(word[hit] & bit[hit] - np.uint64(1))
            left = left[~hit]
            if not len(left):
                break
        return out

    def packed(self) -> tuple[list[int], bytes]:
        return self.sizes, b"".join(b.tobytes() for b in self.bits)

    @classmethod
    def unpacked(cls, sizes: list[int], raw: bytes) -> PerfectHash:
        data, bits, at = np.frombuffer(raw, np.uint8), [], 0
        for size in sizes:
            n = -(-size // 8)
            bits.append(data[at : at + n])
            at += n
        return cls(sizes, bits)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)


def _line_hashes(column: pa.Array, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each line that is looked at, the first of its kind in the row."""
    data, offsets = flat(column)
    start, end, row = lines(data, offsets)
    long = end - start >= least
    h, row = hashes(data, start[long], end[long]), row[long]
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], row[new]


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def line_counts(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(h, n, owner) of every distinct line. Tasks add up their own batches first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", 1 << 20):
                h, row = _line_hashes(part.column("text"), s.least)
                owner = _ids(part.column("doc_id"))[row]
                order = np.lexsort((owner, h))
                h, owner = h[order], owner[order]
                first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
                n = np.diff(np.append(first, len(h)))
                yield pa.RecordBatch.from_arrays([pa.array(signed(h[first])), pa.array(n.astype(np.int64)), pa.array(owner[first])], ["h", "n", "owner"])

    return _slim(docs).mapInArrow(count, "h long, n long, owner long").groupBy("h").agg(F.sum("n").alias("n"), F.min("owner").alias("owner"))


def build_index(docs: DataFrame, s: Settings = Settings()) -> tuple[str, int, int]:
    """The folder of the index, its number of shards and of lines."""
    spark = docs.sparkSession
    counts, path = written(line_counts(docs, s), "lines")
    total = counts.count()
    shards = max(1, -(-total // s.shard_lines))

    def build(table: pa.Table) -> pa.Table:
        keys = table["h"].combine_chunks().to_numpy().view(np.uint64)
        mph = PerfectHash.build(keys)
        at = mph.places(keys)
        arrays = [np.zeros(len(keys), t) for t in (np.uint32, np.uint32, np.int64)]
        for a, v in zip(arrays, (fingerprints(keys), np.minimum(table["n"].to_numpy(), 2**32 - 1), table["owner"].to_numpy())):
            a[at] = v
        sizes, raw = mph.packed()
        return pa.table({"shard": table["shard"][:1].cast(pa.int32()), "sizes": pa.array([sizes], pa.list_(pa.int64())), "bits": pa.array([raw], pa.binary()), **{k: pa.array([a.tobytes()], pa.binary()) for k, a in zip(("fingerprints", "counts", "owners"), arrays)}})

    index = counts.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(build, "shard int, sizes array<long>, bits binary, fingerprints binary, counts binary, owners binary")
    _, folder = written(index, "line-index", ["shard"])
    removed(spark, path)
    return folder, shards, total


class Shard:
    """The arrays of one shard, read from the shared folder."""

    def __init__(self, folder: str, number: int):
        system, path = _system(f"{folder}/shard={number}")
        row = pq.read_table(path, filesystem=system, partitioning=None).to_pylist()
        self.mph = None
        if row:
            self.mph = PerfectHash.unpacked(row[0]["sizes"], row[0]["bits"])
            self.prints, self.counts, self.owners = (np.frombuffer(row[0][k], t) for k, t in (("fingerprints", np.uint32), ("counts", np.uint32), ("owners", np.int64)))

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and owner of each key; 0 and LAST for one that the index doesn't have."""
        count, owner = np.zeros(len(keys), np.int64), np.full(len(keys), LAST)
        if self.mph is not None and len(keys):
            at = self.mph.places(keys)
            known = np.flatnonzero(at >= 0)
            known = known[self.prints[at[known]] == fingerprints(keys[known])]
            count[known], owner[known] = self.counts[at[known]], self.owners[at[known]]
        return count, owner


def foreign_lines(docs: DataFrame, folder: str, shards: int, s: Settings = Settings()) -> DataFrame:
    """(doc, gone): hashes of the lines that each document has to give up."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", 1 << 20):
                h, row = _line_hashes(part.column("text"), s.least)
                doc = _ids(part.column("doc_id"))[row]
                shard = signed(h) % shards
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array((mixed(doc.view(np.uint64)) % np.uint64(s.salts)).astype(np.int32)), pa.array(signed(h)), pa.array(doc)], ["shard", "salt", "h", "doc"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: tuple[int, Shard] | None = None
        for batch in batches:
            shard, h, doc = (batch.column(k).to_numpy() for k in ("shard", "h", "doc"))
            for number in np.unique(shard).tolist():
                if have is None or have[0] != number:
                    have = (number, Shard(folder, number))
                at = np.flatnonzero(shard == number)
                count, owner = have[1].probe(h[at].view(np.uint64))
                gone = at[(count > 1) & (owner != doc[at])]
                yield pa.RecordBatch.from_arrays([pa.array(doc[gone]), pa.array(h[gone])], ["doc", "h"])

    probes = _slim(docs).mapInArrow(emit, "shard int, salt int, h long, doc long").repartition("shard", "salt").sortWithinPartitions("shard")
    return probes.mapInArrow(probe, "doc long, h long").groupBy("doc").agg(F.collect_set("h").alias("gone"))


def rewritten(docs: DataFrame, s: Settings = Settings(), drop_emptied: bool = False, counter: str | None = None) -> DataFrame:
    """The documents without lines that others own or that they repeat. `counter` names a column for how many lines went;
    with `drop_emptied` a document that loses all its text goes too."""
    if counter and counter.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {counter} already")
    folder, shards, _ = build_index(docs, s)
    key, gone = fresh("doc", docs.columns), fresh("gone", docs.columns)
    lost = foreign_lines(docs, folder, shards, s).withColumnsRenamed({"doc": key, "gone": gone})
    both = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).join(lost.hint("shuffle_hash"), key, "left").select(*docs.columns, gone)
    names, n_chars = docs.columns, "n_chars" in docs.columns

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", 1 << 20):
                texts, removed_n, keep = _without(part.column("text"), part.column(gone), s.least)
                columns = {n: part.column(n) for n in names}
                columns["text"] = texts
                if n_chars:
                    kind = columns["n_chars"].type
                    columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts.to_pylist()], pa.int64()).cast(kind)
                if counter:
                    columns[counter] = pa.array(removed_n, pa.int32())
                out = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
                yield out.filter(pa.array(keep)) if drop_emptied else out

    text = both.withColumn("text", F.col("text").cast("string"))
    fields = [f"`{f.name}` {'string' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema] + ([f"`{counter}` int"] if counter else [])
    return text.mapInArrow(write, ", ".join(fields))


def _without(column: pa.Array, gone: pa.Array, least: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts without foreign and repeated lines, how many went, and whether anything is left (or never was there)."""
    data, offsets = flat(column)
    start, end, row = lines(data, offsets)
    n = len(offsets) - 1
    long = np.flatnonzero(end - start >= least)
    h, r = hashes(data, start[long], end[long]), row[long]
    drop = np.zeros(len(start), bool)
    # repeats in the row: all but the first of each (row, hash)
    order = np.lexsort((long, h, r))
    again = np.zeros(len(order), bool)
    again[1:] = (h[order][1:] == h[order][:-1]) & (r[order][1:] == r[order][:-1])
    drop[long[order[again]]] = True
    # foreign lines: (row, hash) pairs that are among the lists
    lists = gone.fill_null([]) if gone.null_count else gone
    taken = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64) if len(lists) else np.zeros(0, np.uint64)
    if len(taken):
        size = np.diff(lists.offsets.to_numpy())
        owner = np.repeat(np.arange(n), size)
        pairs = mixed(taken) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        drop[long[np.isin(mixed(h) + r.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), pairs)]] = True
    removed_n = np.bincount(row[drop], minlength=n)
    left = np.bincount(row[~drop], minlength=n)
    texts = column.to_pylist()
    for k in np.flatnonzero(removed_n).tolist():
        raw, base = data[offsets[k] : offsets[k + 1]].tobytes(), int(offsets[k])
        a, z = np.searchsorted(row, [k, k + 1])
        out, at = [], 0
        for i in range(a, z):
            if drop[i]:
                out.append(raw[at : start[i] - base])
                at = int(end[i]) - base + 1  # and its newline
        out.append(raw[at:])
        if at > len(raw):  # the last line went, and so does the newline before it
            out[-1] = b""
            while out and not out[-1]:
                out.pop()
            if out:
                out[-1] = out[-1][:-1]
        texts[k] = b"".join(out).decode()
    return pa.array(texts, pa.string()), removed_n.astype(np.int32), (left > 0) | (removed_n == 0)
