"""Join of documents by the Jaccard similarity of their word n-grams: the chosen-path method.

1. Each text becomes the set of hashes of its word n-grams (lower case) and a sketch of `width` minhashes, in which two sets
   agree at a place with the probability of their similarity. Documents with equal sets are one set from here on.
2. A run samples each place of the sketch with probability 1 / (threshold * width) and sends a set to one bucket for each sampled
   place, named by the value there. A bucket of up to `small` sets is searched by brute force. A larger one is split by places
   drawn for it, none of them used above it, if that at least halves the pairs to compare and it lies less than `depth` - 1 splits
   deep; otherwise it is searched block against block, so that no task takes more than two blocks and every pair in it is compared.
   Where a set goes follows from its sketch and the paths of the split buckets, which tasks are told; sketches aren't shuffled for it.
3. Runs repeat, and a bucket is split by as many places, until a pair at the threshold has met with probability `recall` in a
   bucket that is searched, even if all buckets above that one were split.
4. A bucket is first searched by sketches alone, a byte a place. Only the sets that have a candidate there come back with their n-grams, for the
   exact similarity; of the texts without any, no n-gram leaves its task. A pair that meets in several buckets counts in the one
   of the least name, which both sets know, as each carries the names of all its buckets.
5. Many near copies of one text don't split. In a bucket of them, those within half the allowed distance of its least set form a
   ball: as 1 - Jaccard is a metric, all pairs in a ball are links, and are counted without being compared or emitted.

What comes out is one row a document, never a row a pair: class, and number of links, each of them exact for the pairs found.
Nothing is capped: a hot n-gram only makes its bucket split.

Defined cases: null and blank texts have no link; rows with a null id are left out; a text of fewer than n words is one n-gram;
rows that share a doc_id are one document, whose different texts add up their links, and join their classes; other columns are
ignored by `classes` and kept by `keep_first`; texts of any length are read whole; empty tables give no rows. Sets are told
apart by 64-bit hashes of them, n-grams by 32 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_pairs
from ..session import cut, removed, written
from .arrays import chunks, flat, fresh, hashes, mixed, signed, words


@dataclass(frozen=True)
class Settings:
    n: int = 3
    threshold: float = 0.5
    recall: float = 0.99
    width: int = 64
    small: int = 1000
    depth: int = 3
    seed: int = 7
    filter_bits: int = 26  # of the bitmap that tells which texts are read again

    def places(self) -> list[int]:
        """Places that the runs sample at the root, in order."""
        out: list[int] = []
        for run in range(10_000):
            draw = _draw(np.full(self.width, run, np.uint64), self)
            for k in np.flatnonzero(draw).tolist():
                out += [k] if k not in out else []
                if 1 - (1 - self.threshold) ** len(out) >= self.recall or len(out) >= self.width:
                    return out
        return out


    def splits(self) -> list[np.ndarray]:
        """For each level of splits the places that its buckets draw from, apart from the root's and the other levels', so that a
        pair's chances at one level don't hang on those at another."""
        top = self.places()
        rest = np.setdiff1d(np.arange(self.width), top)
        levels = max(self.depth - 1, 0)
        while levels and len(rest) // levels < self.drawn(levels):
            levels -= 1
        return [rest[k::levels] for k in range(levels)]

    def drawn(self, levels: int) -> int:
        """Places that a split bucket draws, so that `levels` splits in a row leave the recall."""
        top = len(self.places())
        for k in range(1, self.width):
            met = 1.0
            for _ in range(levels):
                met = 1 - (1 - self.threshold * met) ** k
            if 1 - (1 - self.threshold * met) ** top >= self.recall:
                return k
        return self.width


def _draw(path: np.ndarray, s: Settings) -> np.ndarray:
    """Which places a node samples: path has one row a node (or is one node's, repeated for each place)."""
    place = np.arange(s.width, dtype=np.uint64)
    x = mixed(path * np.uint64(0x9E3779B97F4A7C15) + place * np.uint64(0xD1B54A32D192ED03) + np.uint64(s.seed))
    return x < np.uint64(int(2**64 / max(1.0, s.threshold * s.width)) - 1)


def _gram_sets(column: pa.Array, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes (32 bits) of all rows, ordered by row and hash, and the number in each row."""
    data, offsets = flat(pc.utf8_lower(column.cast(pa.large_string())))
    start, end, row = words(data, offsets)
    h = hashes(data, start, end)
    rows = len(offsets) - 1
    if not len(h):
        return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
    total = np.bincount(row, minlength=rows)
    size = np.where(total >= s.n, total - s.n + 1, np.minimum(total, 1))
    # grams of n words; in a short row the gram takes what words there are
    first = np.concatenate([[0], np.cumsum(total)[:-1]])
    at = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
    owner = np.repeat(np.arange(rows), size)
    g = np.zeros(len(at), np.uint64)
    for k in range(s.n):
        there = at + k < (first + total)[owner]
        g = g * np.uint64(0x9E3779B97F4A7C15) + np.where(there, h[np.minimum(at + k, len(h) - 1)], np.uint64(1))
    key = np.unique(owner.astype(np.uint64) << np.uint64(32) | mixed(g) >> np.uint64(32))
    return (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.bincount((key >> np.uint64(32)).astype(np.int64), minlength=rows)


def _sketches(grams: np.ndarray, first: np.ndarray, s: Settings) -> np.ndarray:
    """Minhashes: rows by places. No row is empty."""
    rng = np.random.default_rng(s.seed)
    a, b = (rng.integers(0, 2**32, s.width, dtype=np.uint32) for _ in range(2))
    out = np.empty((len(first), s.width), np.uint32)
    for k in range(s.width):
        x = (grams ^ b[k]) * (a[k] | np.uint32(1))
        out[:, k] = np.minimum.reduceat(x ^ x >> np.uint32(15), first)
    return out


def _rows(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> list[bytes]:
    raw, w = values.tobytes(), values.itemsize
    return [raw[a * w : (a + n) * w] for a, n in zip(first.tolist(), size.tolist())]


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")


def _parts(batch: pa.RecordBatch, s: Settings) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of a batch: rows that have words, signatures, sizes, grams and where each set begins in them."""
    for part in chunks(batch, "text"):
        grams, size = _gram_sets(part.column("text"), s)
        keep = np.flatnonzero(size)
        size = size[keep]
        first = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)[: len(size)]
        sig = np.add.reduceat(mixed(grams.astype(np.uint64) + np.uint64(1)), first) if len(keep) else np.zeros(0, np.uint64)
        yield part, keep, signed(mixed(sig + size.astype(np.uint64))), size, grams, first


def set_sketches(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, sig, size, sketch) of every document; null but for the id where there are no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, keep, sig, size, grams, first in _parts(batch, s):
                at = np.full(part.num_rows, -1)
                at[keep] = np.arange(len(keep))
                at = pa.array(at, mask=at < 0)
                sketch = _rows(_sketches(grams, first, s).ravel(), np.arange(len(size)) * s.width, np.full(len(size), s.width)) if len(keep) else []
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sig, pa.int64()).take(at), pa.array(size.astype(np.int32)).take(at), pa.array(sketch, pa.binary()).take(at)], ["doc_id", "sig", "size", "sketch"])

    return _slim(docs).mapInArrow(run, "doc_id long, sig long, size int, sketch binary")


def _bitmap(ids: DataFrame, s: Settings) -> np.ndarray:
    """A bitmap with a bit for the hash of each id, and of no more than 2^filter_bits bits however many ids there are."""
    at = F.pmod(F.xxhash64("rep"), F.lit(1 << s.filter_bits))
    words = ids.select(at.alias("b")).groupBy(F.floor(F.col("b") / 32).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 32 as int))")).alias("x")).toArrow()
    out = np.zeros(1 << s.filter_bits - 5, np.uint32)
    out[words["w"].to_numpy()] = words["x"].to_numpy().astype(np.uint32)
    return out


def _with_grams(rows: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """Rows of (rep, sig, ...) with the n-grams of the set. Texts are read again rather than kept, those that a bitmap of the reps
    rules out are dropped before their n-grams are formed, and the rest is joined; the bitmap has a fixed size, so that among very
    many reps it only rules out less."""
    bits = _bitmap(rows, s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("at").to_numpy()
            batch = batch.filter(pa.array(bits[at >> 5] >> (at & 31).astype(np.uint32) & np.uint32(1) > 0))
            for part, keep, sig, size, grams, first in _parts(batch, s):
                ids = part.column("doc_id").take(pa.array(keep))
                one = pa.array(np.sort(np.unique(mixed(ids.to_numpy().view(np.uint64)) ^ sig.view(np.uint64), return_index=True)[1]))  # rows that a run repeats
                yield pa.RecordBatch.from_arrays([ids, pa.array(sig), pa.array(_rows(grams, first, size), pa.binary())], ["rep", "own", "grams"]).take(one)

    full = _slim(docs).where("text is not null").withColumn("at", F.pmod(F.xxhash64("doc_id"), F.lit(1 << s.filter_bits))).mapInArrow(run, "rep long, own long, grams binary")
    both = rows.join(full, "rep")  # an id can have several texts, or the same one again; as an equation the signature would become a join key
    return both.where(F.col("sig").bitwiseXOR(F.col("own")) == 0).drop("own")


def _matrix(column: pa.Array, s: Settings, kind: type = np.uint32) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, s.width)


def _named(path: np.ndarray, place: np.ndarray, value: np.ndarray) -> np.ndarray:
    return mixed(path * np.uint64(0x9E3779B97F4A7C15) + mixed((place.astype(np.uint64) + np.uint64(1) << np.uint64(32)) | value))


def _among(path: np.ndarray, paths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of `path` are among sorted paths, and where in these."""
    at = np.searchsorted(paths, path)
    hit = np.flatnonzero(at < len(paths))
    hit = hit[paths[at[hit]] == path[hit]]
    return hit, at[hit]


def _drawn(path: np.ndarray, pool: np.ndarray, n: int, s: Settings) -> np.ndarray:
    """The places that buckets draw from the pool, which follow from their paths: a row a bucket."""
    out = [np.zeros((0, n), pool.dtype)]
    for part in (path[k : k + 4096] for k in range(0, len(path), 4096)):
        lot = mixed(part[:, None] * np.uint64(0x9E3779B97F4A7C15) + pool.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(s.seed))
        out.append(pool[np.argsort(lot, 1, kind="stable")[:, :n]])
    return np.concatenate(out)


class _Paths:
    """The way of a set through the buckets, which follows from its sketch and from what buckets are split: sketches stay where they
    are, and only the paths travel. splits: for each level the sorted paths of its split buckets, each of which has over `small` sets."""

    def __init__(self, s: Settings):
        self.s, self.places, self.pools, self.splits = s, np.array(s.places()), s.splits(), []
        self.each = s.drawn(len(self.pools))

    def levels(self, sketch: np.ndarray, splits: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of the sketches, parents and paths at each level, the root's first."""
        row, place = np.repeat(np.arange(len(sketch)), len(self.places)), np.tile(self.places, len(sketch))
        parent = np.zeros(len(row), np.uint64)
        path = _named(parent, place, sketch[row, place])
        yield row, parent, path
        for pool, there in zip(self.pools, splits):
            hit, _ = _among(path, there)
            place = _drawn(path[hit], pool, self.each, self.s).ravel()
            row, parent = np.repeat(row[hit], self.each), np.repeat(path[hit], self.each)
            path = _named(parent, place, sketch[row, place])
            yield row, parent, path

    def _parts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for batch in batches:
            for part in (batch.slice(k, 1024) for k in range(0, batch.num_rows, 1024)):
                yield part, _matrix(part.column("sketch"), self.s)

    def last(self, splits: list[np.ndarray]):
        """Emits (parent, path, sig) of the level below the last of the splits."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, sketch in self._parts(batches):
                *_, (row, parent, path) = self.levels(sketch, splits)
                yield pa.RecordBatch.from_arrays([pa.array(signed(parent)), pa.array(signed(path)), part.column("sig").take(pa.array(row))], ["parent", "path", "sig"])

        return run

    def offers(self, paths: np.ndarray, leaders: np.ndarray):
        """Emits (sig, leader, sketch), once for each leader whose bucket, of those with these sorted paths, a set is in."""
        splits = self.splits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, sketch in self._parts(batches):
                found = []
                for row, _, path in self.levels(sketch, splits):
                    hit, at = _among(path, paths)
                    found.append(np.stack([row[hit], leaders[at]]))
                row, leader = np.unique(np.concatenate(found, 1), axis=1)
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column("sig").take(row), pa.array(leader), part.column("sketch").take(row)], ["sig", "leader", "sketch"])

        return run


def _sorted_paths(rows: DataFrame) -> np.ndarray:
    """The paths of large buckets: at most one for each `small` rows."""
    return np.sort(rows.select("path").distinct().toArrow()["path"].to_numpy().view(np.uint64))


def _short(s: Settings):
    """Sketches with the low byte of each place. What agrees in a place still does, so that a search by them misses no candidate that
    whole sketches have; one in 256 of the other places agrees too, and the exact similarity tells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                low = _matrix(batch.column("sketch"), s).astype(np.uint8)
                at = batch.schema.get_field_index("sketch")
                yield batch.set_column(at, "sketch", pa.array([x.tobytes() for x in low], pa.binary()))

    return run


class _Bucket:
    """The sets of one bucket, or of two blocks of it, and the search for pairs that count here."""

    def __init__(self, t: pa.Table, s: Settings):
        self.s, self.lowest = s, s.threshold - 4 * (s.threshold * (1 - s.threshold) / s.width) ** 0.5
        self.sig, self.rep, self.side, self.size, self.copies, self.ball = (t[c].to_numpy() for c in ("sig", "rep", "side", "size", "copies", "ball"))
        self.sketch, self.leaf = _matrix(t["sketch"], s, np.uint8), int(t["leaf"][0].as_py())
        leaves = t["leaves"].combine_chunks()
        row = np.repeat(np.arange(len(leaves)), pc.list_value_length(leaves).to_numpy())
        name = leaves.flatten().to_numpy()
        row, name = row[name < self.leaf], name[name < self.leaf]
        kinds, name, n = np.unique(name, return_inverse=True, return_counts=True)
        shared = np.flatnonzero(n > 1)
        to = np.full(len(kinds), -1)
        to[shared] = np.arange(len(shared))
        hit = to[name] >= 0
        self.before = np.zeros((len(self.sig), len(shared)), bool)  # in which buckets of lesser names a set is too
        self.before[row[hit], to[name[hit]]] = True
        self.crossed = bool(self.side[0] or self.side[-1])

    def candidates(self, i: int) -> np.ndarray:
        other = np.arange(i + 1, len(self.sig))
        keep = (np.minimum(self.size[i], self.size[other]) >= self.s.threshold * np.maximum(self.size[i], self.size[other])) & (self.rep[other] != self.rep[i])
        if self.crossed:
            keep &= self.side[other] != self.side[i]
        if self.ball[i]:
            keep &= self.ball[other] != self.ball[i]
        other = other[keep]
        if len(other):
            other = other[(self.sketch[other] == self.sketch[i]).mean(1) >= self.lowest]
        if len(other) and self.before.shape[1]:
            other = other[~(self.before[other] & self.before[i]).any(1)]
        return other


def _exact(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Similarities of a set with others; sets are sorted."""
    size = np.fromiter(map(len, others), np.int64, len(others))
    joined = np.concatenate(others)
    hit = np.searchsorted(one, joined)
    hit[hit == len(one)] = 0
    shared = np.add.reduceat(one[hit] == joined, np.concatenate([[0], np.cumsum(size)[:-1]]))
    return shared / (len(one) + size - shared)


def _by_bucket(search) -> object:
    """Runs `search` over each bucket of rows that come ordered by bucket, side and sig; a bucket is whole, whatever the batches. A set
    whose text was read from several rows counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            by = [table[c].to_numpy() for c in ("bucket", "side", "sig")]
            again = np.logical_and.reduce([c[1:] == c[:-1] for c in by])
            if again.any():
                table = table.filter(pa.array(np.concatenate([[True], ~again]))).combine_chunks()
            key = table["bucket"].to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for a, z in zip(cuts, cuts[1:]):
                if z - a > 1:
                    yield from search(table.slice(a, z - a))

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            key = table["bucket"].to_numpy()
            other = np.flatnonzero(key != key[-1])
            last = int(other[-1]) + 1 if len(other) else 0
            rest = table.slice(last)
            if last:
                yield from done(table.slice(0, last).combine_chunks())
        if rest is not None:
            yield from done(rest.combine_chunks())

    return run


def _flagged(s: Settings):
    """The sets of a bucket that have a candidate in it."""

    def search(t: pa.Table) -> Iterator[pa.RecordBatch]:
        b = _Bucket(t, s)
        mark = np.zeros(len(b.sig), bool)
        for i in range(len(b.sig) - 1):
            other = b.candidates(i)
            if len(other):
                mark[i] = mark[other] = True
        if mark.any():
            yield from t.filter(pa.array(mark)).combine_chunks().to_batches()

    return _by_bucket(search)


def _linked(s: Settings, expand: bool):
    """(sig, rep, root, links) of the sets of a bucket that have a link in it: the documents linked by pairs that count here, and the
    least rep of those that hang together. With `expand` (a, b, jaccard): the pairs themselves."""

    def search(t: pa.Table) -> Iterator[pa.RecordBatch]:
        b = _Bucket(t, s)
        sets = [np.frombuffer(g, np.uint32) for g in t["grams"].to_pylist()]
        links, root = np.zeros(len(sets), np.int64), b.rep.copy()
        found: list[tuple[np.ndarray, ...]] = []
        for i in range(len(sets) - 1):
            other = b.candidates(i)
            if not len(other):
                continue
            jaccard = _exact(sets[i], [sets[j] for j in other])
            hit = jaccard >= s.threshold
            if not hit.any():
                continue
            other = other[hit]
            if expand:
                found.append((np.full(len(other), b.sig[i]), b.sig[other], jaccard[hit]))
                continue
            links[i] += b.copies[other].sum()
            links[other] += b.copies[i]
            if (root[other] != root[i]).any():
                both = np.union1d(root[other], root[i])
                root[np.isin(root, both)] = both[0]
        if expand:
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["a", "b", "jaccard"])
            return
        at = np.flatnonzero(links)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(c[at]) for c in (b.sig, b.rep, root, links)], ["sig", "rep", "root", "links"])

    return _by_bucket(search)


def _near(s: Settings):
    """(sig, ball) of the sets within half the allowed distance of the leader whose row comes first."""

    def search(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if t["side"][0].as_py():
            return
        sets = [np.frombuffer(g, np.uint32) for g in t["grams"].to_pylist()]
        hit = np.flatnonzero(_exact(sets[0], sets[1:]) >= (1 + s.threshold) / 2) + 1
        yield pa.RecordBatch.from_arrays([t["sig"].combine_chunks().take(pa.array(hit)), t["leader"].combine_chunks().take(pa.array(hit))], ["sig", "ball"])

    return _by_bucket(search)


def _alike(s: Settings):
    """(sig, leader, agree): the places of the sketch at which a set and its leader agree, if that is as often as in a ball."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                agree = (_matrix(batch.column("sketch"), s) == _matrix(batch.column("l_sketch"), s)).sum(1)
                keep = pa.array(agree >= (1 + s.threshold) / 2 * s.width * 0.9)
                yield pa.RecordBatch.from_arrays([batch.column("sig"), batch.column("leader"), pa.array(agree.astype(np.int32))], ["sig", "leader", "agree"]).filter(keep)

    return run


def _once(leaves: DataFrame) -> DataFrame:
    """The leaves without buckets that hold the same sets as another. Documents that are much alike meet at most places, and would be
    searched there again and again."""
    hashed = [F.bit_xor(F.xxhash64(F.lit(k), "sig")) for k in (1, 2)]
    by = leaves.groupBy("leaf").agg(F.count("*").alias("n"), F.min("sig").alias("lo"), F.max("sig").alias("hi"), hashed[0].alias("x"), hashed[1].alias("y"))
    return leaves.join(by.groupBy("n", "lo", "hi", "x", "y").agg(F.min("leaf").alias("leaf")).select("leaf"), "leaf", "left_semi")


class Join:
    """The distinct sets of the documents, their buckets and balls. Its tables lie in the shared folder until `close`."""

    def __init__(self, docs: DataFrame, s: Settings = Settings(), balls: bool = True):
        self.docs, self.s, self.spark, self.folders = docs, s, docs.sparkSession, []
        sets, folder = written(set_sketches(docs, s), "set-sketches")
        self.nodes = self._kept(sets.select("doc_id", "sig").distinct(), "nodes")
        known = sets.where("sig is not null")
        copies = self.nodes.where("sig is not null").groupBy("sig").agg(F.count("*").alias("copies"))
        self.sets = self._kept(known.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.first("size").alias("size"), F.first("sketch").alias("sketch")).join(copies, "sig"), "distinct-sets")
        removed(self.spark, folder)
        self.paths = _Paths(s)
        self.leaves, self.blocks = self._buckets()
        self.balls = self._balls() if balls and self.blocks is not None else None

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        table, folder = written(df, name)
        self.folders.append(folder)
        return table

    def close(self) -> None:
        for folder in self.folders:
            removed(self.spark, folder)

    def _buckets(self) -> tuple[DataFrame, DataFrame | None]:
        """(leaf, sig) of the buckets that are searched whole, and (path, sig) of those searched in blocks, if any."""
        s, sketches, to = self.s, self.sets.select("sig", "sketch"), self.paths
        fields = "parent long, path long, sig long"
        leaves, blocks = [], []
        rows = sketches.mapInArrow(to.last([]), fields).select("path", "sig")
        for level in range(len(to.pools) + 1):
            count = rows.groupBy("path").agg(F.count("*").alias("m")).where("m > 1")
            rows = cut(rows.join(count, "path"))
            leaves.append(rows.where(F.col("m") <= s.small).select(F.col("path").alias("leaf"), "sig"))
            large = rows.where(F.col("m") > s.small)
            if large.isEmpty():
                break
            if level == len(to.pools):
                blocks.append(large.select("path", "sig"))
                break
            below = cut(sketches.mapInArrow(to.last([*to.splits, _sorted_paths(large)]), fields))
            work = below.groupBy("parent", "path").agg(F.count("*").cast("double").alias("c")).groupBy("parent").agg(F.sum(F.col("c") * F.col("c")).alias("work"))
            split = cut(large.groupBy("path").agg(F.first("m").cast("double").alias("m")).join(work.withColumnRenamed("parent", "path"), "path").where("2 * work <= m * m").select("path"))
            blocks.append(large.join(split, "path", "left_anti").select("path", "sig"))
            if split.isEmpty():
                break
            to.splits.append(_sorted_paths(split))
            rows = below.join(split.withColumnRenamed("path", "parent"), "parent", "left_semi").select("path", "sig")
        whole = cut(_once(reduce(DataFrame.unionByName, leaves)))
        if not blocks:
            return whole, None
        rest = cut(reduce(DataFrame.unionByName, blocks))
        return whole, None if rest.isEmpty() else rest

    def _balls(self) -> DataFrame:
        """(sig, ball): sets of unsplit large buckets and the leader to whose ball they belong, if any. A set goes to the leader whose
        sketch is most like its own, and is then compared with it."""
        s = self.s
        leaders = self.blocks.groupBy("path").agg(F.min("sig").alias("leader")).toArrow()
        paths, leader = leaders["path"].to_numpy().view(np.uint64), leaders["leader"].to_numpy()
        order = np.argsort(paths)
        offers = self.sets.select("sig", "sketch").mapInArrow(self.paths.offers(paths[order], leader[order]), "sig long, leader long, sketch binary")
        heads = offers.where("sig = leader").select("leader", F.col("sketch").alias("l_sketch"))
        seen = offers.join(heads, "leader")
        best = cut(seen.select("sig", "leader", "sketch", "l_sketch").mapInArrow(_alike(s), "sig long, leader long, agree int").groupBy("sig").agg(F.max_by("leader", F.struct("agree", "leader")).alias("leader")))
        size = best.groupBy("leader").agg(F.ceil(F.count("*") / s.small).cast("int").alias("parts"))
        members = best.where("sig <> leader").join(size, "leader").select("leader", F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("side"), "sig")
        first = size.select("leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), F.col("leader").alias("sig"))
        rows = self._kept(members.unionByName(first).join(self.sets.select("sig", "rep"), "sig"), "ball-members")
        full = _with_grams(rows, self.docs, s).withColumn("bucket", F.xxhash64("leader", "part"))
        found = full.select("bucket", "side", "sig", "leader", "grams").repartition("bucket").sortWithinPartitions("bucket", "side", "sig").mapInArrow(_near(s), "sig long, ball long")
        own = best.where("sig = leader").select("sig", F.col("leader").alias("ball"))
        return self._kept(found.unionByName(own), "balls")

    def _in_balls(self, rows: DataFrame) -> DataFrame:
        none = F.lit(0).cast("long")
        return rows.withColumn("ball", none) if self.balls is None else rows.join(self.balls, "sig", "left").withColumn("ball", F.coalesce("ball", none))

    def _units(self) -> DataFrame:
        """(bucket, leaf, side, sig, ball): what is searched, each bucket in one task. ball is 0 for none."""
        s, zero = self.s, F.lit(0).cast("long")
        whole = self.leaves.select(F.col("leaf").alias("bucket"), "leaf", F.lit(0).alias("side"), "sig")
        if self.blocks is None:
            return self._in_balls(whole)
        # a block is of one ball, or of sets of none and of small balls; blocks of the same ball aren't held against each other
        rows = self._in_balls(self.blocks)
        group = rows.groupBy("path", "ball").agg(F.count("*").alias("n"))
        group = group.withColumn("own", F.when(F.col("n") > s.small, F.col("ball")).otherwise(zero))
        parts = cut(group.groupBy("path", "own").agg(F.ceil(F.sum("n") / s.small).cast("int").alias("parts")))
        rows = rows.join(group.select("path", "ball", "own"), ["path", "ball"]).join(parts, ["path", "own"]).withColumn("part", F.pmod(F.xxhash64("sig", "path"), F.col("parts")).cast("int"))
        each = rows.select("path", "own", "part", "sig", "ball").join(parts.select("path", F.col("own").alias("to"), F.col("parts").alias("to_parts")), "path").where("own <> to or own = 0")
        each = each.withColumn("to_part", F.explode(F.sequence(F.lit(0), F.col("to_parts") - 1)))
        here, there = F.struct("own", "part"), F.struct(F.col("to").alias("own"), F.col("to_part").alias("part"))
        each = each.withColumn("lo", F.least(here, there)).withColumn("hi", F.greatest(here, there))
        inner = F.when(F.col("lo") == F.col("hi"), 0).when(here == F.col("lo"), 1).otherwise(2)
        return self._in_balls(whole).unionByName(each.select(F.xxhash64("path", "lo", "hi").alias("bucket"), F.col("path").alias("leaf"), inner.alias("side"), "sig", "ball"))

    def found(self, expand: bool = False) -> DataFrame:
        """See `_linked`; pairs of a ball are not among them."""
        s = self.s
        member = self.leaves if self.blocks is None else self.leaves.unionByName(self.blocks.select(F.col("path").alias("leaf"), "sig"))
        leaves = member.groupBy("sig").agg(F.collect_set("leaf").alias("leaves"))
        short = self.sets.mapInArrow(_short(s), self.sets.schema)
        known = short.join(leaves, "sig").select("sig", "rep", "size", "copies", "sketch", "leaves")
        fields = "bucket long, leaf long, side int, sig long, ball long, rep long, size int, copies long, sketch binary, leaves array<long>"
        names = [f.split()[0] for f in fields.split(", ")]
        rows = self._units().join(known, "sig").select(*names)
        flagged = self._kept(rows.repartition("bucket").sortWithinPartitions("bucket", "side", "sig").mapInArrow(_flagged(s), fields), "flagged")
        full = _with_grams(flagged, self.docs, s)
        return full.select(*names, "grams").repartition("bucket").sortWithinPartitions("bucket", "side", "sig").mapInArrow(_linked(s, expand), "a long, b long, jaccard double" if expand else "sig long, rep long, root long, links long")

    def classes(self) -> DataFrame:
        """(doc_id, class_id, links) of every document; see `classes`."""
        found = self._kept(self.found(), "links")
        links = found.groupBy("sig").agg(F.sum("links").alias("links"))
        edges = found.select(F.col("rep").alias("u"), F.col("root").alias("v"))
        sets = self.sets.select("sig", "rep", "copies").join(links, "sig", "left").withColumn("links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
        if self.balls is not None:
            reps = self.sets.select("sig", "rep", "copies")
            inside = self.balls.join(reps, "sig")
            edges = edges.unionByName(inside.select("ball", F.col("rep").alias("u")).join(reps.select(F.col("sig").alias("ball"), F.col("rep").alias("v")), "ball").select("u", "v"))
            total = inside.groupBy("ball").agg(F.sum("copies").alias("all"))
            more = self.balls.join(total, "ball").select("sig", "all")
            sets = sets.join(more, "sig", "left").withColumn("links", F.col("links") + F.coalesce(F.col("all") - F.col("copies"), F.lit(0))).drop("all")
        mixed_up = self.nodes.where("sig is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
        several = self.nodes.join(mixed_up, "doc_id").join(self.sets.select("sig", "rep"), "sig")
        edges = edges.unionByName(several.select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))
        groups = connected_pairs(edges.where("u <> v"))
        named = sets.join(groups, sets["rep"] == groups["id"], "left").select("sig", F.coalesce("component", "rep").alias("class_id"), "links")
        return self.nodes.join(named, "sig", "left").groupBy("doc_id").agg(F.min(F.coalesce("class_id", "doc_id")).alias("class_id"), F.coalesce(F.sum("links"), F.lit(0)).alias("links"))


def classes(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, class_id, links), a row for each document: `links` is the number of other documents at or above the threshold, copies
    included; the class is named by the least doc_id of those that are linked, directly or through others."""
    join = Join(docs, s)
    out, _ = written(join.classes(), "classes")
    join.close()
    return out


def pairs(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_a, doc_b, jaccard), doc_a < doc_b: every pair, copies included, for tables in which there aren't too many to list."""
    join = Join(docs, s, balls=False)
    found = join.found(expand=True).select("a", "b", "jaccard")
    a, b = (join.nodes.select(F.col("sig").alias(k), F.col("doc_id").alias(f"doc_{k}")) for k in ("a", "b"))
    near = found.join(a, "a").join(b, "b").select(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b"), "jaccard")
    same = a.where("a is not null").join(b, (F.col("a") == F.col("b")) & (F.col("doc_a") < F.col("doc_b"))).select("doc_a", "doc_b", F.lit(1.0).alias("jaccard"))
    out, _ = written(near.where("doc_a <> doc_b").unionByName(same).groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard")), "pairs")
    join.close()
    return out


def keep_first(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The documents without those that are linked, directly or through others, to one with a smaller doc_id; rows without an id stay."""
    key = fresh("id", docs.columns)
    gone = classes(docs, s).where("doc_id <> class_id").select(F.col("doc_id").alias(key))
    return docs.join(gone, docs["doc_id"].cast("long") == gone[key], "left_anti")
