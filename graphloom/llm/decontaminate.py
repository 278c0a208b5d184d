"""Benchmark decontamination by q-gram lemma filtering.

Texts are folded (lower case, every run of bytes that are neither letters nor digits becomes one space). A benchmark item is
cut into overlapping windows, one every half window, so that a verbatim run of 1.5 windows holds a whole one; a window of length m with at most e = floor(rate * m) edits shares at least
T = m + 1 - q * (e + 1) q-grams with its copy, and all of them lie within e diagonals of each other. So the shared q-grams
are counted in overlapping diagonal bands, a band with T or more is a region to look at, and a banded alignment of the window
against the region decides. Where T would fall below 1, as in items shorter than a window, q is lowered until it doesn't, so that the
budget holds for every length. Windows of an item that follow each other in a text make one match.

Each document is read once, in its own task, with no shuffle. The benchmark is the small side: its text is measured first,
and is taken in slices of at most `slice_bytes`, one pass over the documents for each, however large it is.

Defined cases: a null or empty text holds nothing; items whose folded text is shorter than `q` bytes are not searched for, while one of
`q` bytes is found wherever it stands, in the middle of a word too; texts of any length are searched whole; of several places of
an item in a document the one with the most agreeing characters is given, then that with the fewest edits, then the first; a null doc_id is reported as null; repeated rows and repeated items are each reported; columns besides doc_id and text (item_id and
text) are ignored by `matches` and kept by `clean`; empty tables give no match.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import chunks, flat, mixed, ranges

_BITS = 22
_FOLD = np.full(256, 32, np.uint8)
for _c in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _FOLD[_c] = _c
for _c in range(65, 91):
    _FOLD[_c] = _c + 32


@dataclass(frozen=True)
class Settings:
    q: int = 10
    rate: float = 0.08
    window: int = 63
    slice_bytes: int = 8 << 20

    def __post_init__(self):
        if not (2 <= self.q <= 16 and self.q <= self.window <= 2048 and 0 <= self.rate < 0.5):
            raise ValueError("q from 2 to 16, a window from q to 2048 bytes, a rate below a half")

    def edits(self, m: int) -> int:
        return int(self.rate * m)

    def q_of(self, m: int) -> int:
        """The length of the q-grams for windows of m bytes: with all edits of the budget at least one is left."""
        return min(self.q, m // (self.edits(m) + 1))


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes of all rows, each row closed by a zero byte, and the offsets of the rows."""
    f = _FOLD[data]
    gap = f == 32
    keep = np.ones(len(f), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    keep[offsets[:-1][offsets[:-1] < len(f)]] = True
    new = np.concatenate([[0], np.cumsum(keep)])[offsets] + np.arange(len(offsets))
    out = np.zeros(new[-1], np.uint8)
    mask = np.ones(len(out), bool)
    mask[new[1:] - 1] = False
    out[mask] = f[keep]
    return out, new


def grams(data: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit key of the q-gram at every position, by doubling; q from 2 to 16."""
    if len(data) < q:
        return np.zeros(0, np.uint64)
    parts, have, at = {1: data.astype(np.uint64)}, 1, 0
    while have * 2 <= min(q, 8):
        g = parts[have]
        parts[have * 2] = g[:-have] | g[have:] << np.uint64(8 * have)
        have *= 2
    n = len(data) - q + 1
    key = np.zeros(n, np.uint64)
    for size in sorted(parts, reverse=True):
        while q - at >= size:
            key = key * np.uint64(0x9E3779B97F4A7C15) + parts[size][at : at + n]
            at += size
    return key * np.uint64(0xD6E8FEB86659FD93)


class Index:
    """The windows of some benchmark items and the places of their q-grams. `items` are (item_id, folded text)."""

    def __init__(self, items: list[tuple[int | None, bytes]], q: int, s: Settings):
        self.q, self.ids, self.text, self.edits, self.need = q, [], [], [], []
        self.at, self.of, self.whole = [], [], {}  # where a window begins in its item, and which item that is
        keys, owner, place = [], [], []
        for k, (item, whole) in enumerate(items):
            self.whole[k] = np.frombuffer(whole, np.uint8)
            last = max(0, len(whole) - s.window)
            for at in sorted({*range(0, last + 1, max(1, s.window // 2)), last}):
                part = np.frombuffer(whole[at : at + s.window], np.uint8)
                m, e = len(part), s.edits(len(part))
                g = grams(part, q)
                keys.append(g)
                owner.append(np.full(len(g), len(self.ids)))
                place.append(np.arange(len(g)))
                self.ids.append(item)
                self.text.append(part)
                self.at.append(at)
                self.of.append(k)
                self.edits.append(e)
                self.need.append(m + 1 - q * (e + 1))
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        self.owner, self.place = np.concatenate(owner)[order], np.concatenate(place)[order]
        self.keys, self.first, self.count = np.unique(keys[order], return_index=True, return_counts=True)
        self.table = np.zeros(1 << _BITS, bool)
        self.table[self.slot(self.keys)] = True
        self.edits, self.need = np.array(self.edits), np.array(self.need)
        self.width = int(max(8, 2 * self.edits.max()))  # of the bands' step; a band overlaps the next by the largest budget
        self.over = int(self.edits.max())

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return (mixed(keys) >> np.uint64(64 - _BITS)).astype(np.int64)

    def search(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, window, start, end, edits) of every window found; positions in the folded text of the row."""
        g = grams(data, self.q)
        at = np.flatnonzero(self.table[self.slot(g)])
        where = np.minimum(np.searchsorted(self.keys, g[at]), len(self.keys) - 1)
        real = self.keys[where] == g[at]
        at, where = at[real], where[real]
        if not len(at):
            return []
        n = self.count[where]
        entry = ranges(self.first[where], n)
        at = np.repeat(at, n)
        window = self.owner[entry]
        diagonal = at - self.place[entry] + 4096
        band = diagonal // self.width
        low = diagonal % self.width < self.over  # also in the band before
        span = len(data) // self.width + 4096
        keys = np.concatenate([window * span + band, (window * span + band - 1)[low]])
        keys, shared = np.unique(keys, return_counts=True)
        if not (shared >= self.need[keys // span]).any():
            return []
        # a q-gram of the window counts once in a band, however often the text repeats it
        likely = keys[shared >= self.need[keys // span]]
        place = self.place[entry]
        both, place = np.concatenate([window * span + band, (window * span + band - 1)[low]]), np.concatenate([place, place[low]])
        kept = np.isin(both, likely)
        keys, shared = np.unique(np.unique(both[kept] * 4096 + place[kept]) // 4096, return_counts=True)
        window, band = keys // span, keys % span
        good = shared >= self.need[window]
        regions = []
        for w, b in zip(window[good].tolist(), band[good].tolist()):
            part, e = self.text[w], int(self.edits[w])
            lo = b * self.width - 4096 - e
            hi = lo + self.width + self.over + len(part) + 2 * e
            # a band near a border can reach into the next row; each row that it touches is looked at
            r0, r1 = np.searchsorted(offsets, [max(lo, 0), max(hi, 1) - 1], "right") - 1
            for r in range(int(r0), min(int(r1), len(offsets) - 2) + 1):
                a, z = max(lo, int(offsets[r])), min(hi, int(offsets[r + 1]) - 1)
                if z - a < len(part) - e:
                    continue
                regions.append((r, w, a, z))
        out = {}
        for r, w, a, z in self._possible(data, regions):
            found = aligned(self.text[w], data[a:z], int(self.edits[w]))
            if found:
                start, end, edits = found
                key = (r, w, a + start - int(offsets[r]))
                if key not in out or edits < out[key][1]:
                    out[key] = (a + end - int(offsets[r]), edits)
        return [(r, w, s, e, k) for (r, w, s), (e, k) in out.items()]


    def _possible(self, data: np.ndarray, regions: list[tuple[int, int, int, int]], lot: int = 512) -> list[tuple[int, int, int, int]]:
        """The regions that hold their window within its edits: many alignments side by side, each given up once all its ends are too dear."""
        out = []
        for first in range(0, len(regions), lot):
            some = regions[first : first + lot]
            size = np.array([len(self.text[w]) for _, w, _, _ in some])
            budget = self.edits[[w for _, w, _, _ in some]]
            n = max(z - a for _, _, a, z in some)
            part, text = np.zeros((len(some), size.max()), np.uint8), np.zeros((len(some), n), np.uint8)
            for k, (_, w, a, z) in enumerate(some):
                part[k, : size[k]] = self.text[w]
                text[k, : z - a] = data[a:z]
            alive, good, col = np.arange(len(some)), [], np.arange(n + 1, dtype=np.int16)
            row = np.zeros((len(some), n + 1), np.int16)
            for i in range(part.shape[1] + 1):
                over = size[alive] == i
                if over.any():
                    good.append(alive[over & (row.min(1) <= budget[alive])])
                keep = ~over
                if i % 8 == 7:
                    keep &= row.min(1) <= budget[alive]
                if not keep.all():
                    alive, row = alive[keep], row[keep]
                if not len(alive):
                    break
                new = row + np.int16(1)
                np.minimum(new[:, 1:], row[:, :-1] + (text[alive] != part[alive, i, None]), out=new[:, 1:])
                new -= col
                row = np.minimum.accumulate(new, 1, out=new)
                row += col
            out += [some[k] for k in sorted(np.concatenate(good).tolist())] if good else []
        return out

    def joined(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int | None, int, int, int, int]]:
        """(row, item_id, start, end, edits, length) of the passages found: windows of an item that overlap in it and in the text."""
        by: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}
        for r, w, a, z, k in self.search(data, offsets):
            by.setdefault((r, self.of[w]), []).append((a, z, w, k))
        out = []
        for (r, item), found in by.items():
            runs: list[list[tuple[int, int, int, int]]] = []
            for x in sorted(found):
                for run in runs:
                    y = run[-1]
                    ahead = self.at[x[2]] - self.at[y[2]]
                    if 0 < ahead <= len(self.text[y[2]]) and abs(x[0] - y[0] - ahead) <= x[3] + y[3]:
                        run.append(x)
                        break
                else:
                    runs.append([x])
            for run in runs:
                (a, _, first, _), (_, z, last, _) = run[0], run[-1]
                part = self.whole[item][self.at[first] : self.at[last] + len(self.text[last])]
                whole = aligned(part, data[offsets[r] + a : offsets[r] + z], sum(x[3] for x in run)) if len(run) > 1 else None
                if whole:
                    out.append((r, self.ids[first], a + whole[0], a + whole[1], whole[2], len(part)))
                else:
                    out += [(r, self.ids[w], b, y, k, len(self.text[w])) for b, y, w, k in run]
        return out


class Indexes:
    """An index for each length of q-grams that a slice of benchmark items needs."""

    def __init__(self, items: list[tuple[int | None, str | None]], s: Settings):
        data, offsets = folded(*flat(pa.array([t.lower() if t else t for _, t in items], pa.large_string())))
        by: dict[int, list[tuple[int | None, bytes]]] = {}
        for (item, _), a, z in zip(items, offsets.tolist(), offsets[1:].tolist()):
            whole = data[a : z - 1].tobytes().strip()
            if len(whole) >= s.q:
                by.setdefault(s.q_of(min(len(whole), s.window)), []).append((item, whole))
        self.of = [Index(found, q, s) for q, found in sorted(by.items())]

    def search(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        return [x for index in self.of for x in index.search(data, offsets)]

    def joined(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int | None, int, int, int, int]]:
        return [x for index in self.of for x in index.joined(data, offsets)]


def aligned(part: np.ndarray, region: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """The best place of `part` in `region` with at most `most` edits (start, end, edits); both ends of the region are free."""
    exact = region.tobytes().find(part.tobytes())
    if exact >= 0:
        return exact, exact + len(part), 0
    if not most:
        return None
    n = len(region)
    col = np.arange(n + 1)
    row, start = np.zeros(n + 1, np.int64), col.copy()
    for i, c in enumerate(part.tolist(), 1):
        sub = row[:-1] + (region != c)
        up = row + 1
        new, begin = up.copy(), start.copy()
        better = sub <= new[1:]
        new[1:] = np.where(better, sub, new[1:])
        begin[1:] = np.where(better, start[:-1], begin[1:])
        lean = new - col
        low = np.minimum.accumulate(lean)
        # where the value comes from the left, the start comes with it
        source = np.maximum.accumulate(np.where(lean <= low, col, 0))
        row, start = low + col, begin[source]
        if row.min() > most:
            return None
    end = int(np.argmin(row))
    return (int(start[end]), end, int(row[end])) if row[end] <= most else None


def _slices(benchmark: DataFrame, s: Settings) -> Iterator[list[tuple[int, str | None]]]:
    """The items in slices that fit a task's memory, in the order of their ids; the text is measured before it is taken."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.length("text") > 0)
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).head()["n"]
    parts = max(1, -(-int(total) // s.slice_bytes))
    if parts == 1:
        yield sorted((tuple(r) for r in items.collect()), key=lambda r: (r[0] is None, r[0], r[1]))
        return
    for k in range(parts):
        yield sorted((tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()), key=lambda r: (r[0] is None, r[0], r[1]))


def _found(batch: pa.RecordBatch, text: str, search) -> Iterator[tuple[pa.RecordBatch, list]]:
    for part in chunks(batch, text, 1 << 18):
        data, offsets = flat(pc.utf8_lower(part.column(text).cast(pa.large_string())))
        yield part, search(*folded(data, offsets))


def matches(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, item_id, start, end, edits, similarity): the longest match of each item in each document."""
    schema = "doc_id long, item_id long, start long, end long, edits int, similarity double"
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for items in _slices(benchmark, settings):
        index = Indexes(items, settings)

        def scan(batches: Iterator[pa.RecordBatch], index: Indexes = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for part, found in _found(batch, "text", index.joined):
                    ids, best = part.column("doc_id").to_pylist(), {}
                    for r, item, a, z, k, n in found:
                        rank = (k - n, k, a)  # the most characters that agree
                        if (r, item) not in best or rank < best[r, item][0]:
                            best[r, item] = rank, (a, z, k, 1 - k / n)
                    rows += [(ids[r], item, *b) for (r, item), (_, b) in sorted(best.items(), key=lambda x: (x[0][0], x[0][1] is None, x[0][1] or 0))]
                columns = list(zip(*rows)) if rows else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.int32(), pa.float64()])], ["doc_id", "item_id", "start", "end", "edits", "similarity"])

        part = slim.mapInArrow(scan, schema)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents without those that hold a benchmark window; all their columns, in one pass with no shuffle."""
    for items in _slices(benchmark, settings):
        index = Indexes(items, settings)

        def scan(batches: Iterator[pa.RecordBatch], index: Indexes = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, found in _found(batch, "text", index.search):
                    keep = np.ones(part.num_rows, bool)
                    keep[[r for r, *_ in found]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(scan, docs.schema)
    return docs
