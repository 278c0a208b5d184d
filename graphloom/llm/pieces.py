"""SentencePiece encoding and decoding by one walk over the trie of distinct words.

A text is cut into words, each with the mark of the spaces before it; no piece goes beyond a word. A task takes the words it has
not met, sorts them, so that they lie in the order of a depth-first walk over their trie, and keeps one forward table for the
path from the root: a word computes only the characters beyond the prefix that it shares with the one before.

Forward table, by the kind of model:
* unigram: at each position the best score of a segmentation that ends there, and its last piece (Viterbi); the longer last piece
  among equals; a character that is no piece may stand as unknown, at the library's penalty;
* BPE: at each position the last piece of the prefix's encoding. A piece t fits after the encoding of the text before it exactly if
  the pair (last piece there, t) encodes to itself, so the step is the same walk over the pieces that end here, with this test in
  place of the maximum. It gives the library's merges exactly, which a maximum over a BPE model's scores would not.
Characters without a piece fall back to their bytes.

Nothing is shuffled; each task reads its texts once. The model's file is a parameter; its kind is read from it. A BPE vocabulary can
be read as a unigram one, with scores by rank, to segment by Viterbi what has no unigram model.

Defined cases: a null text gives null ids, an empty one none; a null doc_id stays null; repeated rows each get their ids; other
columns are ignored; empty tables give empty results; texts and words of any length are encoded whole; the
mark itself in a text reads as a space, as in the library, so that such a text doesn't come back as it was. A model of another
kind, with user-defined symbols, or with pieces that go beyond a word is an error.
"""

from __future__ import annotations

import math
import os
import re
import struct
from collections.abc import Iterator
from functools import cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import chunks, flat, lists, ranges

MODEL = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers") + "/piece_bpe_32k.model"
MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
_TEXT = re.compile("[ ▁]+[^ ▁\n]*|[^ ▁\n]+|\n")


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protocol buffer message."""

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    at = 0
    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, raw[at : at + n]
            at += n


def read_model(raw: bytes) -> tuple[list[tuple[str, float, int]], int]:
    """Pieces (text, score, type) of a model file, and its kind."""
    pieces, kind = [], UNIGRAM
    for number, value in _fields(raw):
        if number == 1:
            f = dict(_fields(value))
            pieces.append((f[1].decode(), struct.unpack("<f", f.get(2, b"\0\0\0\0"))[0], f.get(3, NORMAL)))
        elif number == 2:
            kind = dict(_fields(value)).get(3, UNIGRAM)
    return pieces, kind


def rank_score(k: int) -> float:
    """Log probability of the k-th piece by Zipf's law, in 64ths, so that sums are exact in the library's floats too."""
    return -round(math.log(k + 1) * 64) / 64


class Vocabulary:
    """Pieces of a model: strings to ids and scores, byte pieces, and the bytes that each id stands for."""

    def __init__(self, pieces: list[tuple[str, float]], bpe: bool, byte_ids: list[int] | None = None, special: frozenset[int] = frozenset(), unknown: int = 0, eod: int = -1):
        self.size, self.eod = len(pieces), eod
        self.bpe, self.byte_ids, self.unknown = bpe, byte_ids, unknown
        aside = special | frozenset(byte_ids or ())
        self.ids = {p: k for k, (p, _) in enumerate(pieces) if k not in aside}
        self.score = [x for _, x in pieces]
        self.unknown_score = min((x for k, (_, x) in enumerate(pieces) if k not in aside), default=0.0) - 10.0
        self.longest = max((len(p) for p in self.ids), default=1)
        shown = [b"" if k in special else p.replace(MARK, " ").encode() for k, (p, _) in enumerate(pieces)]
        for value, k in enumerate(byte_ids or ()):
            shown[k] = bytes([value])
        self.text_of = shown
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids):
            raise ValueError("a piece goes beyond a word")
        self.fits: dict[int, bool] = {}
        self.names = [p for p, _ in pieces]
        self.found = ahocorasick.Automaton()  # all pieces that end at a position, the longest first
        for p, k in self.ids.items():
            if not bpe or len(p) == 1 or self.merged(p) == [p]:
                self.found.add_word(p, (len(p), k))
        if self.ids:
            self.found.make_automaton()

    @classmethod
    def load(cls, path: str, by_rank: bool = False) -> Vocabulary:
        """`by_rank`: as a unigram vocabulary whose scores follow from the order of the pieces, by Zipf's law."""
        with open(path, "rb") as f:
            pieces, kind = read_model(f.read())
        types = [x for _, _, x in pieces]
        if kind not in (UNIGRAM, BPE) or USER_DEFINED in types:
            raise ValueError(f"{path}: neither a BPE nor a unigram model, or one with user-defined symbols")
        byte_ids = [k for k, x in enumerate(types) if x == BYTE]
        special = frozenset(k for k, x in enumerate(types) if x in (UNKNOWN, CONTROL, UNUSED))
        scored = [(p, rank_score(k) if by_rank else x) for k, (p, x, _) in enumerate(pieces)]
        names = [p for p, _, _ in pieces]
        return cls(scored, kind == BPE and not by_rank, byte_ids if len(byte_ids) == 256 else None, special, types.index(UNKNOWN), names.index("</s>") if "</s>" in names else -1)

    def merged(self, text: str) -> list[str]:
        """Plain BPE: the adjacent pair with the best score is joined, the leftmost of equals, until none is a piece."""
        parts, ids, score = list(text), self.ids, self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or score[k] > best):
                    best, at = score[k], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fit(self, key: int) -> bool:
        """Whether two pieces, packed as left * 2^20 + right, stay as they are side by side."""
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        a, b = self.names[key >> 20], self.names[key & 0xFFFFF]
        got = self.fits[key] = self.merged(a + b) == [a, b]
        return got

    def fallback(self, c: str) -> list[int]:
        return [self.byte_ids[b] for b in c.encode()] if self.byte_ids else [self.unknown]

    def encode_sorted(self, words: list[str]) -> list[list[int]]:
        """Ids of sorted distinct words, by one walk over their trie."""
        out, before = [], ""
        # at depth i of the path: the last piece (-1: a character of its own bytes, or the root), where it starts, the score
        last, start, best = [-1], [0], [0.0]
        fits, longest, bpe, found, score = self.fits, self.longest, self.bpe, self.found, self.score
        for word in words:
            n, i = min(len(word), len(before)), 0
            if word[:n] == before[:n]:
                i = n
            else:
                while word[i] == before[i]:
                    i += 1
            del last[i + 1 :], start[i + 1 :], best[i + 1 :]
            size = len(word) + 1
            last += [-1] * (size - len(last))
            start += range(len(start) - 1, size - 1)
            if bpe:
                done = i
                for end, (length, k) in found.iter(word, max(0, i - longest + 1)) if self.ids else ():
                    if end < done:
                        continue
                    at = end + 1 - length
                    left = last[at]
                    # after a character of its own a piece begins anew, as nothing merges with such a character
                    if left >= 0:
                        key = left << 20 | k
                        good = fits.get(key)
                        if not (good if good is not None else self.fit(key)):
                            continue
                    last[end + 1], start[end + 1], done = k, at, end + 1
            else:
                best += [None] * (size - len(best))
                at_end: dict[int, list[tuple[int, int]]] = {}
                for end, piece in found.iter(word, max(0, i - longest + 1)) if self.ids else ():
                    at_end.setdefault(end + 1, []).append(piece)
                for end in range(i + 1, size):
                    ends = at_end.get(end, ())
                    for length, k in ends:
                        value = best[end - length] + score[k]
                        if best[end] is None or value > best[end]:
                            last[end], start[end], best[end] = k, end - length, value
                    if not ends or ends[-1][0] > 1:  # the character is no piece of its own
                        value = best[end - 1] + self.unknown_score
                        if best[end] is None or value > best[end]:
                            last[end], start[end], best[end] = -1, end - 1, value
            ids, end = [], len(word)
            while end:
                at = start[end]
                if last[end] >= 0:
                    ids.append(last[end])
                elif self.byte_ids or not (ids and ids[-1] == self.unknown):  # a run of unknown characters is one
                    ids += reversed(self.fallback(word[at:end]))
                end = at
            out.append(ids[::-1])
            before = word
        return out


class Encoder:
    """Encodes texts; keeps what it has encoded, up to a bound."""

    most = 800_000

    def __init__(self, path: str = MODEL, by_rank: bool = False):
        self.path, self.by_rank, self.vocabulary = path, by_rank, None
        self.reset()

    def __reduce__(self):  # the tasks of a Python worker share one
        return _encoder, (self.path, self.by_rank)

    def ready(self) -> Vocabulary:
        if self.vocabulary is None:
            self.vocabulary = Vocabulary.load(self.path, self.by_rank)
        return self.vocabulary

    def reset(self) -> None:
        self.at: dict[str, int] = {}
        self.flat, self.first, self.size = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    def learn(self, words: set[str]) -> None:
        if len(self.at) + len(words) > self.most and self.at:
            self.reset()
        new = sorted(words - self.at.keys(), key=lambda w: w.replace(" ", MARK))
        ids = self.vocabulary.encode_sorted([w.replace(" ", MARK) for w in new])
        n, sizes = len(self.at), np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(sizes.sum())
        while n + len(new) > len(self.first):
            self.first, self.size = np.resize(self.first, 2 * len(self.first)), np.resize(self.size, 2 * len(self.size))
        while self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.int32, total)
        self.size[n : n + len(new)] = sizes
        self.first[n : n + len(new)] = self.used + np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(new) else 0
        self.used += total
        self.at.update(zip(new, range(n, n + len(new))))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number in each text."""
        self.ready()
        cut = [_TEXT.findall(" " + t) if t else [] for t in texts]
        known = self.at.keys()
        need = set().union(*cut)
        if not need <= known:
            if len(self.at) + len(need - known) > self.most:
                self.reset()
            self.learn(need)
        get = self.at.__getitem__
        place = np.fromiter(map(get, chain.from_iterable(cut)), np.int64, sum(map(len, cut)))
        size = self.size[place]
        ids = self.flat[ranges(self.first[place], size)]
        edge = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(np.int64)]
        return ids, np.diff(edge)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts that flat ids stand for, without the space that encoding puts first, and their offsets."""
        self.ready()
        if not hasattr(self, "shown"):
            parts = self.vocabulary.text_of
            self.width = np.fromiter(map(len, parts), np.int64, len(parts))
            self.begin = np.concatenate([[0], np.cumsum(self.width)[:-1]])
            self.shown = np.frombuffer(b"".join(parts), np.uint8)
        width = self.width[ids]
        data = self.shown[ranges(self.begin[ids], width)]
        edge = np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        keep = np.ones(len(data), bool)
        has = edge[1:] > edge[:-1]
        front = edge[:-1][has]
        front = front[data[front] == 32]
        keep[front] = False
        return data[keep], np.concatenate([[0], np.cumsum(keep)])[edge]


@cache
def _encoder(path: str, by_rank: bool) -> Encoder:
    return Encoder(path, by_rank)


def encoded(docs: DataFrame, encoder: Encoder | None = None) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip): round_trip tells whether decoding the ids gives the text back, byte for byte."""
    encoder = encoder or Encoder()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                texts = part.column("text")
                ids, counts = encoder.encode(texts.to_pylist())
                data, edge = encoder.decode(ids, counts)
                want, offsets = flat(texts)
                same = np.diff(edge) == np.diff(offsets)
                if len(data) == len(want) and same.all():
                    wrong = np.flatnonzero(data != want)
                    same[np.searchsorted(offsets, wrong, "right") - 1] = False
                else:
                    same &= [data[a:b].tobytes() == want[c:d].tobytes() for a, b, c, d in zip(edge, edge[1:], offsets, offsets[1:])]
                column = lists(ids, counts, pa.int32())
                if texts.null_count:
                    column = pa.ListArray.from_arrays(column.offsets, column.values, mask=texts.is_null())
                none = texts.is_null().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), column, pa.array(counts.astype(np.int32), mask=none), pa.array(same, mask=none)], ["doc_id", "ids", "n_tokens", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, n_tokens int, round_trip boolean")


def decoded(rows: DataFrame, encoder: Encoder | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); ids that form no valid text get replacement characters."""
    encoder = encoder or Encoder()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("ids")
            counts = np.array([len(x) if x is not None else 0 for x in column.to_pylist()], np.int64)
            data, edge = encoder.decode(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
            texts = [None if none else data[a:b].tobytes().decode(errors="replace") for none, a, b in zip(column.is_null().to_pylist(), edge, edge[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
