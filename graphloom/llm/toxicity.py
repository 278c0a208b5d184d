"""Toxicity of text that hides its words: noisy-channel restoration, then a word classifier.

1. A character language model (4-grams over 32 folded classes, interpolated) is counted over all documents: each task counts
   its texts into one array, the sums are at most 2^20 numbers however large the corpus.
2. A token whose spelling has more than one reading (a digit or sign that stands for a letter, a letter three times or more, a separator
   inside) spans a lattice of readings, each with a channel cost; so does a run of single characters set apart by spaces. Digits
   and signs may always stand for themselves, a bracket, bar or exclamation mark at an end of a token also for none of it, so that
   the model tells numbers and punctuation from words. Viterbi search picks the reading: the state is the last three classes,
   nothing is pruned. Any other token has one reading and needs no search.
3. A boosted model over words and word stems, fitted on at most `sample` labelled documents of each class, adds up the
   weights of what a document's distinct restored words have of them.

Defined cases: a null or empty text scores the model's bias and is not toxic; with no toxic label, or no clean one, nothing is
toxic (score 0); labels with a null id or class are ignored, and an id labelled both ways is taken as toxic; a document is judged
row by row, so repeated rows get the same result; of readings with equal scores the one met first stays, and at the end of a token
the last in the order of characters; of equal gains the first feature is taken; other columns are ignored by `scores` and kept by `clean`; a very long text or
token is read whole. Empty tables give empty results.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import chunks, flat, words

LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
GAP = frozenset(" \t\n\r.-_*~,;:/\\'\"`^#=")
_ACCENT = {}
for _i in range(0xA0, 0x250):
    _d = unicodedata.normalize("NFKD", chr(_i).lower())
    if _d and "a" <= _d[0] <= "z":
        _ACCENT[_i] = _d[0]
_ACCENT |= {0xDF: "s", 0xF8: "o", 0xE6: "a"}
DIGIT, OTHER = 28, 29
_EDGE = "".join(sorted({*".,;:?\"'()[]{}<>-_*~#=/\\`^|%&"} - LEET.keys()))  # signs that stand for no letter, at the ends of a token
_BOUND = "(|!"  # signs that stand for a letter or, at the ends of a token, for none of it
_CODE = {chr(97 + i): i + 1 for i in range(26)} | {str(i): DIGIT for i in range(10)} | dict.fromkeys(GAP, 0)

# byte tables of the same folding: plain bytes, and the second byte after 0xC3 (Latin-1 letters)
_PLAIN = np.full(256, OTHER, np.uint8)
for _i in range(128):
    _PLAIN[_i] = _CODE.get(chr(_i).lower(), 0 if _i <= 32 else OTHER)
_LATIN = np.full(256, OTHER, np.uint8)
for _i in range(0x80, 0xC0):
    _LATIN[_i] = _CODE.get(_ACCENT.get(_i + 0x40, ""), OTHER)


@dataclass(frozen=True)
class Settings:
    sample: int = 4000  # labelled documents of each class that the classifier is fitted on, at most
    rounds: int = 64  # words in the classifier, at most
    gain: float = 8.0  # a feature enters the classifier if it lowers the loss by this much
    least: int = 5  # and if this many toxic documents of the sample have it
    stems: tuple[int, ...] = (4, 5, 6, 7)  # lengths of the prefixes that are features beside whole words
    dense: float = 0.01  # a feature is dense if this share of a document's distinct tokens have it; being dense is a feature too
    ridge: float = 0.05  # of the last fit, in which all features taken are weighed together
    swap: float = -1.0  # log costs of the channel: a sign for a letter
    drop: float = -1.0  # a separator inside a word
    keep: float = -3.0  # a word's end inside a run of spaced characters
    more: float = -0.5  # a letter written three times or more (twice is ordinary spelling)


def _classes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Character classes of all texts in a row, a gap after each, runs of gaps made one."""
    code = _PLAIN[data]
    high = np.flatnonzero(data >= 128)
    if len(high):
        before = data[np.maximum(high - 1, 0)]
        code[high] = np.where(before == 0xC3, _LATIN[data[high]], OTHER)
        lead = data >= 0xC0
    else:
        lead = np.zeros(len(data), bool)
    ends = np.zeros(len(data), bool)
    ends[offsets[1:][offsets[1:] > 0] - 1] = True
    code[ends] = 0
    code = code[~lead]
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0)
    return code[keep].astype(np.int32)


def character_counts(docs: DataFrame) -> DataFrame:
    """(gram, n): 4-grams of character classes over all texts, packed as five bits each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 20, np.int64)
        for batch in batches:
            for part in chunks(batch, "text"):
                c = np.concatenate([np.zeros(3, np.int32), _classes(*flat(part.column("text")))])
                if len(c) > 3:
                    total += np.bincount(c[:-3] << 15 | c[1:-2] << 10 | c[2:-1] << 5 | c[3:], minlength=1 << 20)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["gram", "n"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def character_model(docs: DataFrame) -> np.ndarray:
    """log p(d | a b c) at index a b c d; interpolated with the lower orders in proportion to what each has seen."""
    got = character_counts(docs).toPandas()
    c4 = np.zeros(1 << 20)
    c4[got["gram"].to_numpy(int)] = got["n"].to_numpy(float)
    c4 = c4.reshape(32, 32, 32, 32)
    p = np.full(32, 1 / 32)
    for c in (c4.sum((0, 1, 2)), c4.sum((0, 1)), c4.sum(0), c4):
        seen = c.sum(-1, keepdims=True)
        kinds = (c > 0).sum(-1, keepdims=True) + 1
        p = (c + kinds * p) / (seen + kinds)
    return np.log(p).astype(np.float32).ravel()


class Restorer:
    """Restores tokens and runs of single characters under a character model."""

    def __init__(self, model: np.ndarray, s: Settings):
        self.model, self.s, self.list, self.arcs = model, s, None, {}

    def __getstate__(self):
        return self.model, self.s

    def __setstate__(self, state):
        self.model, self.s = state
        self.list, self.arcs = None, {}

    def _arcs(self, c: str, run: int, spaced: bool, edge: bool) -> list[tuple[str, float, list[int], float]]:
        """What a run of one character may stand for: text, cost, its classes (of a run of one class the first four at most), and how
        often the last of these is met again."""
        s = self.s
        if c in GAP:
            arcs = [(" ", s.keep), ("", 0.0)] if spaced else [(" ", 0.0), ("", s.drop)]
        elif "a" <= c <= "z":
            arcs = [(c * run, 0.0)] if run < 3 else [(c, s.more), (c * 2, s.more)]
        else:
            arcs = [(c * run, 0.0), *([(" ", 0.0)] if edge and c in _BOUND else [])]
            for letter in LEET.get(c, ""):
                arcs += [(letter, s.swap), *([(letter * 2, s.swap)] if run > 1 else [])]
        return [(text, cost, [_CODE.get(e, OTHER) for e in text[:4]], max(0, len(text) - 4)) for text, cost in arcs]

    def decode(self, text: str, spaced: bool = False) -> str:
        """The best reading of one lattice; `text` is folded."""
        if self.list is None:
            self.list, self.arcs = self.model.tolist(), {}
        logp, n, i = self.list, len(text), 0
        inner, last = n - len(text.lstrip(_BOUND)), len(text.rstrip(_BOUND))
        best: dict[int, tuple[float, str]] = {0: (0.0, "")}  # by the last three classes
        while i < n:
            c, j = text[i], i + 1
            while j < n and text[j] == c:
                j += 1
            key = (c, min(j - i, 4), spaced, i < inner or i >= last)
            arcs = self.arcs.get(key)
            if arcs is None or j - i > 4:
                arcs = self._arcs(c, j - i, *key[2:])
                if j - i <= 4:
                    self.arcs[key] = arcs
            after: dict[int, tuple[float, str]] = {}
            for state, (score, out) in best.items():
                for emit, cost, codes, more in arcs:
                    at, total = state, score + cost
                    for code in codes:
                        if code or at & 31:
                            at = at << 5 | code
                            total += logp[at]
                            at &= 0x7FFF
                    if more:  # a run of one class: from the fourth on each costs the same
                        total += more * logp[at << 5 | codes[-1]]
                    if at not in after or total > after[at][0]:
                        after[at] = (total, out + emit)
            best, i = after, j
        return max(((v + (logp[k << 5] if k & 31 else 0.0), t) for k, (v, t) in best.items()))[1]

    @staticmethod
    def fold(token: str) -> str:
        token = token.lower()
        return token if token.isascii() else token.translate(_ACCENT)

    def token(self, raw: str) -> tuple[str, bool]:
        """The words that a token stands for, and whether restoring changed it."""
        t = self.fold(raw)
        plain = t.strip(_EDGE)
        if plain.isalpha() and plain.isascii():
            if not _MORE.search(plain):
                return plain, False
        elif not _SOME.search(plain):
            return plain, False
        best = self.decode(plain).strip()
        core = plain.strip(_BOUND)
        if best in (plain, core) or best and best.replace(" ", "") == "".join(c for c in core if c not in GAP):
            joined = best not in (plain, core) and " " not in best
            return best, joined
        return best, True

    def spaced(self, run: str) -> str:
        return self.decode(self.fold(run), True)


_MORE = re.compile(r"(.)\1\1")
_SOME = re.compile("[a-z" + re.escape("".join(LEET)) + "]")
_RUN = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")


def spaced_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows in which three single characters stand one after the other."""
    start, end, row = words(data, offsets)
    one = (end - start == 1) | (end - start == 2) & (data[start] >= 0xC2) if len(start) else np.zeros(0, bool)
    hit = np.flatnonzero(one[:-2] & one[1:-1] & one[2:]) if len(one) > 2 else np.zeros(0, int)
    return np.unique(row[hit][row[hit] == row[hit + 2]]) if len(hit) else hit


def features(word: str, stems: tuple[int, ...]) -> list[str]:
    """The word itself and its prefixes, each marked by a star."""
    return [word, *(word[:k] + "*" for k in stems if len(word) >= k)]


class Judge:
    """Scores texts; `weights` are those of features. Keeps the tokens that it found to be plain and of no weight."""

    most = 200_000

    def __init__(self, restorer: Restorer, weights: dict[str, float] | None, bias: float):
        self.restorer, self.weights, self.bias = restorer, weights, bias
        self.plain: set[str] = set()
        self.known: dict[str, tuple[list[str], str | None]] = {}

    def of(self, token: str) -> tuple[list[str], str | None]:
        """The features of a token that have weight (without weights: its words), and its restored form if that differs."""
        best, changed = self.restorer.token(token)
        found = best.split()
        if self.weights is not None:
            found = [f for w in found for f in features(w, self.restorer.s.stems) if f in self.weights or f + "%" in self.weights]
        return found, best if changed else None

    def read(self, text: str, spaced: bool) -> tuple[dict[str, int], int, dict[str, str], str | None]:
        """Features and how many distinct tokens have each, the number of tokens, changed tokens, and the text with its spaced
        runs restored if there were any."""
        found, changed, after = {}, {}, None
        if spaced:
            new = _RUN.sub(lambda m: b if len((b := self.restorer.spaced(m[0])).split()) < len(m[0].split()) else m[0], text)
            if new != text:
                text = after = new
        if len(self.plain) > self.most or len(self.known) > self.most:
            self.plain, self.known = set(), {}
        tokens = set(text.split())
        for t in tokens - self.plain:
            got = self.known.get(t)
            if got is None:
                got = self.of(t)
                if not got[0] and got[1] is None:
                    self.plain.add(t)
                    continue
                self.known[t] = got
            for f in got[0]:
                found[f] = found.get(f, 0) + 1
            if got[1] is not None:
                changed[t] = got[1]
        return found, len(tokens), changed, after

    def odds(self, found: dict[str, int], size: int) -> float:
        total, dense = self.bias, self.restorer.s.dense * size
        for f in sorted(found):
            total += self.weights.get(f, 0.0)
            if found[f] >= dense:
                total += self.weights.get(f + "%", 0.0)
        return total

    def score(self, text: str, spaced: bool) -> tuple[float, int, str | None]:
        """Log odds of being toxic, distinct tokens restored (a text's spaced runs count as one), and the restored text if it differs."""
        found, size, changed, after = self.read(text, spaced)
        if not changed and after is None:
            return self.odds(found, size), 0, None
        return self.odds(found, size), len(changed) + (after is not None), re.sub(r"\S+", lambda m: changed.get(m[0], m[0]), text if after is None else after)


def fitted(docs: DataFrame, labels: DataFrame, restorer: Restorer, s: Settings) -> tuple[dict[str, float], float]:
    """Weights of words and the bias. Each round takes the word that lowers the logistic loss most."""
    both = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    pick = both.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample).unionByName(both.where("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = slim.join(F.broadcast(pick), "doc_id").where(F.col("text").isNotNull())  # the sample is bounded by 2 * s.sample rows

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            rare = set(spaced_rows(*flat(texts)).tolist())
            reader = Judge(restorer, None, 0.0)
            out = [sorted(w for w, n in reader.read(t, k in rare)[0].items() for _ in range(n)) for k, t in enumerate(texts.to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(pa.string())), batch.column("toxic")], ["doc_id", "words", "toxic"])

    got = rows.select("doc_id", "text", "toxic").mapInArrow(read, "doc_id long, words array<string>, toxic int").toArrow()
    got = got.take(pc.sort_indices(got["doc_id"]))
    y = got["toxic"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return {}, -1.0
    lists = got["words"].combine_chunks()
    doc = np.repeat(np.arange(len(y), dtype=np.int32), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    coded = pc.dictionary_encode(lists.flatten())
    code, names = coded.indices.to_numpy(), coded.dictionary
    del lists, coded, got
    size = np.bincount(doc, minlength=len(y))
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    labels_of: list[str] = []

    def take(of: np.ndarray, strings: pa.Array, end: str) -> None:
        """Features of one kind that enough toxic documents have: `of` gives each word's, -1 for none."""
        has = of[code] >= 0
        pair, n = np.unique(of[code[has]].astype(np.int64) * len(y) + doc[has], return_counts=True)
        n = n.astype(np.int32)
        for keep, mark in ((np.ones(len(n), bool), ""), (n >= s.dense * size[pair % len(y)], "%")):
            feature, row = (pair[keep] // len(y)).astype(np.int32), (pair[keep] % len(y)).astype(np.int32)
            seen = np.bincount(feature, weights=y[row], minlength=len(strings)) >= s.least
            number = (np.cumsum(seen) - 1 + len(labels_of)).astype(np.int32)
            rows = seen[feature]
            parts.append((number[feature[rows]], row[rows]))
            labels_of.extend(x + end + mark for x in strings.filter(pa.array(seen)).to_pylist())

    take(np.arange(len(names)), names, "")
    for k in s.stems:
        stem = pc.dictionary_encode(pc.utf8_slice_codeunits(names, 0, k))
        of = stem.indices.to_numpy().copy()
        of[pc.utf8_length(names).to_numpy() < k] = -1
        take(of, stem.dictionary, "*")
    # each part is in the order of its features and rows, and the numbers of the features go up from part to part
    code, doc, names = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), labels_of
    parts.clear()
    if not len(code):
        return {}, -1.0
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    kind = code[first]
    stop = np.append(first[1:], len(doc))
    base = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    odds, taken, x = np.full(len(y), base), [], np.ones((len(y), 1))
    for _ in range(s.rounds):
        p = 1 / (1 + np.exp(-odds))
        g, h = _sums(y - p, doc, first), _sums(p * (1 - p), doc, first)
        gain = np.where(g > 0, g * g / (h + 1), 0)
        gain[taken] = 0
        k = int(np.argmax(gain))
        if gain[k] < s.gain:
            break
        taken.append(k)
        column = np.zeros((len(y), 1))
        column[doc[first[k] : stop[k]]] = 1
        x = np.hstack([x, column])
        beta = _logistic(x, y, s.ridge)
        odds = x @ beta
    if not taken:
        return {}, -1.0
    weights = {names[kind[k]]: float(w) for k, w in zip(taken, beta[1:])}
    return weights, min(float(beta[0]), -0.1)


def _sums(values: np.ndarray, doc: np.ndarray, first: np.ndarray, run: int = 1 << 19) -> np.ndarray:
    """Sum of the values of each feature's documents, a run of features at a time."""
    out, at = np.empty(len(first)), 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(first, first[at] + run)))
        end = first[to] if to < len(first) else len(doc)
        out[at:to] = np.add.reduceat(values[doc[first[at] : end]], first[at:to] - first[at])
        at = to
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Logistic regression by Newton's method; the first column is the bias and carries no penalty."""
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    beta = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def judge(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Judge:
    restorer = Restorer(character_model(docs), s)
    return Judge(restorer, *fitted(docs, labels, restorer, s))


def scores(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, score, toxic, restorations, restored): the restored text where it differs from the text, else null."""
    by = judge(docs, labels, s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                got = _scored(by, part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([g[0] for g in got], pa.float64()), pa.array([g[0] > 0 for g in got], pa.bool_()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.string())], ["doc_id", "score", "toxic", "restorations", "restored"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, toxic boolean, restorations int, restored string")


def _scored(by: Judge, column: pa.Array) -> list[tuple[float, int, str | None]]:
    rare = set(spaced_rows(*flat(column)).tolist())
    return [by.score(t or "", k in rare) for k, t in enumerate(column.to_pylist())]


def clean(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The documents that are not toxic, with all their columns, in one pass with no shuffle."""
    by = judge(docs, labels, s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                rare = set(spaced_rows(*flat(part.column("text"))).tolist())
                found = (by.read(t or "", k in rare)[:2] for k, t in enumerate(part.column("text").to_pylist()))
                yield part.filter(pa.array([by.odds(*f) <= 0 for f in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
