"""A hidden Markov language model over words: Baum-Welch training over the whole corpus, exact likelihoods by the forward recursion.

A sequence is a line of a document; a word is a run of letters and digits, in lower case. The texts are read once into runs of
sequences of like lengths: codes of words, and the hashes that they stand for, in the shared folder. Each round of Baum-Welch is
one pass over these: a task runs the scaled forward and backward recursions, all sequences of a run side by side, adds up the
expected counts of its words (a number for each state) and of the transitions, and gives one packed array for each shard of the
words' hashes. A shard's arrays are added up and written to the shared folder; the next pass reads its emission probabilities from
there. Every word of the corpus is counted; one seen fewer than `least` times is read as the unknown word. The number of shards
follows from the number of distinct words that the tasks have found.
Training starts from states that differ clearly (emissions by a factor of up to e^spread, each state followed by itself with
probability `stay`), as EM hardly moves from a start near uniform, and goes on until a round gains less than `tolerance` nats a
token.

The emission table grows with the vocabulary, so its size is measured each round: up to `held_bytes` a task keeps it whole,
beyond that it fetches one shard at a time and keeps only the rows of the words at hand.

Defined cases: a null or empty text, or one without words, has no tokens, log likelihood 0 and null perplexity; a null doc_id stays
null; repeated rows count as often as they occur, and each gets its score; other columns are ignored; an empty table gives an empty
result; texts and lines of any length are read whole, and the scaling keeps their likelihoods exact (a task holds some 250 bytes for
each word of its longest line). Packed counts have 32 bits a number, sums 64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import removed, scratch_path, written
from .arrays import chunks, flat, hashes, mixed, pieces
from .files import _system

_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
REST = -1  # the shard of transitions, first states, log likelihood and tokens


@dataclass(frozen=True)
class Settings:
    states: int = 6
    rounds: int | None = None  # so many rounds; None: as many as it takes
    tolerance: float = 0.005  # nats a token that a round gains, below which training ends
    spread: float = 2.0
    stay: float = 0.98
    least: int = 2  # times that a word of the vocabulary is seen
    smoothing: float = 0.01
    shard_words: int = 1 << 20  # words that the tasks give to a shard, about
    held_bytes: int = 256 << 20
    seed: int = 11


@dataclass
class Model:
    """Start and transition probabilities; where the emission counts are (None: the state before the first round)."""

    start: np.ndarray
    move: np.ndarray
    folder: str | None = None
    totals: np.ndarray | None = None  # expected tokens of each state
    unknown: np.ndarray | None = None  # and those of them that are rare words
    words: int = 0
    shards: int = 1
    log_likelihood: float = 0.0
    tokens: int = 0


def initial(s: Settings) -> Model:
    rng = np.random.default_rng(s.seed)
    start, move = rng.uniform(1, 2, s.states), rng.uniform(1, 2, (s.states, s.states))
    return Model(start / start.sum(), s.stay * np.eye(s.states) + (1 - s.stay) * move / move.sum(1, keepdims=True))


_held: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}


def _by_shard(words: np.ndarray, shards: int) -> Iterator[tuple[int, int, int]]:
    """Shards of sorted words, by the first bits of their hashes, and where each begins and ends; shards is a power of two."""
    bits = (shards - 1).bit_length()
    if not bits:
        yield 0, 0, len(words)
        return
    owner = (words >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    yield from zip(owner[first].tolist(), first.tolist(), [*first[1:].tolist(), len(owner)])


class Emissions:
    """p(word | state) of sorted distinct word hashes."""

    def __init__(self, model: Model, s: Settings):
        self.model, self.s = model, s
        self.keep = model.words * (8 + 4 * s.states) <= s.held_bytes

    def shard(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        key = (self.model.folder, number)
        if key in _held:
            return _held[key]
        system, path = _system(f"{self.model.folder}/shard={number}")
        if system.get_file_info(path).type.name == "NotFound":
            got = np.zeros(0, np.uint64), np.zeros((0, self.s.states), np.float32)
        else:
            table = pq.read_table(path, filesystem=system, partitioning=None, columns=["h", "c"])
            h, c = (np.frombuffer(b"".join(table[n].to_pylist()), k) for n, k in (("h", np.uint64), ("c", np.float32)))
            got = h, c.reshape(-1, self.s.states)
        if self.keep:
            if key[0] not in {k[0] for k in _held}:
                _held.clear()  # the tables of earlier rounds
            _held[key] = got
        return got

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities (words by states) and whether each word is known."""
        k = self.s.states
        if self.model.folder is None:
            noise = mixed(words[:, None] + np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)
            return 1e-4 * np.exp(self.s.spread * (noise / 2.0**53 - 1)), np.ones(len(words), bool)
        counts, known = np.tile(self.model.unknown, (len(words), 1)), np.zeros(len(words), bool)
        for number, a, z in _by_shard(words, self.model.shards):
            h, c = self.shard(number)
            if len(h):
                at = np.minimum(np.searchsorted(h, words[a:z]), len(h) - 1)
                hit = np.flatnonzero(h[at] == words[a:z])
                counts[a + hit], known[a + hit] = c[at[hit]], True
        x = self.s.smoothing
        return (counts + x) / (self.model.totals + x * (self.model.words + 1)), known


class Run:
    """Sequences in time-major order: the first words of all, then the second words, the longer sequences first."""

    def __init__(self, word: np.ndarray, active: np.ndarray):
        self.word, self.active = word, active  # sequences of more than t words
        self.edge = np.concatenate([[0], np.cumsum(active)]).tolist()

    def forward(self, b: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward probabilities and scales of all words. b: p(word | state) of all words."""
        alpha, scale, one, edge = np.empty_like(b), np.empty(len(b)), np.ones(b.shape[1]), self.edge
        for t, n in enumerate(self.active.tolist()):
            a, z = edge[t], edge[t + 1]
            x = alpha[a:z]
            if t:
                np.matmul(alpha[edge[t - 1] : edge[t - 1] + n], m.move, out=x)
                x *= b[a:z]
            else:
                np.multiply(m.start, b[a:z], out=x)
            c = np.matmul(x, one, out=scale[a:z])
            x /= c[:, None]
        return alpha, scale

    def likelihoods(self, scale: np.ndarray) -> np.ndarray:
        """The log likelihood of each sequence."""
        sequence = np.arange(len(scale)) - np.repeat(self.edge[:-1], self.active)
        return np.bincount(sequence, np.log(scale), int(self.active[0]) if len(self.active) else 0)

    def expected(self, b: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected states of every word, transitions, first states, and the log likelihood of all."""
        alpha, scale = self.forward(b, m)
        moves, beta, edge, back = np.zeros_like(m.move), np.ones_like(b), self.edge, np.ascontiguousarray(m.move.T)
        ahead = b / scale[:, None]
        for t in range(len(self.active) - 1, 0, -1):
            a, n = edge[t - 1], int(self.active[t])
            x = ahead[edge[t] : edge[t + 1]]
            x *= beta[edge[t] : edge[t + 1]]
            moves += alpha[a : a + n].T @ x
            np.matmul(x, back, out=beta[a : a + n])
        alpha *= beta
        first = alpha[: edge[1]].sum(0) if len(self.active) else np.zeros(b.shape[1])
        return alpha, moves * m.move, first, float(np.log(scale).sum())


class Sequences:
    """The lines of texts as sequences of words, the longest first; `words` are their sorted distinct hashes."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        self.rows, found = 0, []
        for block in [column] if isinstance(column, pa.Array) else column.chunks:
            for part in chunks(pa.RecordBatch.from_arrays([block], ["text"]), "text"):  # a megabyte at a time, as its bytes take much more
                data, offsets = flat(pc.utf8_lower(part.column("text").cast(pa.large_string())))
                start, end, row = pieces(data, offsets, _APART)
                line = np.cumsum(data == 10)[start] if len(start) else start
                found.append((hashes(data, start, end), row + self.rows, line))
                self.rows += len(offsets) - 1
        h, row, line = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        coded = pa.array(h).dictionary_encode()
        words = coded.dictionary.to_numpy()
        order = np.argsort(words)
        self.words, rank = words[order], np.empty(len(words), np.int32)
        rank[order] = np.arange(len(words), dtype=np.int32)
        self.word = rank[coded.indices.to_numpy()]
        self.tokens = np.bincount(row, minlength=self.rows)
        first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (line[1:] != line[:-1])])) if len(row) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(row)))
        order = np.argsort(-size, kind="stable")
        self.first, self.size = first[order], size[order]
        self.row = row[self.first]

    def runs(self, most: int = 250_000) -> Iterator[tuple[Run, np.ndarray]]:
        """Runs of about `most` words, or of one longer sequence, and the row of each sequence."""
        total, at = np.cumsum(self.size), 0
        while at < len(total):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
            first, size = self.first[at:to], self.size[at:to]
            active = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")
            sequence = np.arange(int(active.sum())) - np.repeat(np.concatenate([[0], np.cumsum(active)[:-1]]), active)
            yield Run(self.word[first[sequence] + np.repeat(np.arange(size[0]), active)], active), self.row[at:to]
            at = to


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h = np.concatenate([p[0] for p in parts])
    order = np.argsort(h, kind="stable")
    h, c = h[order], np.concatenate([p[1] for p in parts])[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[first], np.add.reduceat(c, first, dtype=float)


def encoded(docs: DataFrame, lot: int = 8 << 20) -> DataFrame:
    """(words, codes, active, distinct): the sequences of about `lot` bytes of text a row, run by run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for column in _lots(batches, lot):
            q = Sequences(column)
            if len(q.words):
                runs = [r for r, _ in q.runs()]
                yield pa.RecordBatch.from_arrays([pa.array([q.words.tobytes()]), pa.array([[r.word.astype(np.uint32).tobytes() for r in runs]], pa.list_(pa.binary())), pa.array([[r.active.astype(np.uint32).tobytes() for r in runs]], pa.list_(pa.binary())), pa.array([len(q.words)], pa.int64())], ["words", "codes", "active", "distinct"])

    return docs.select(F.col("text").cast("string").alias("text")).where("text is not null").mapInArrow(run, "words binary, codes array<binary>, active array<binary>, distinct long")


def _lots(batches: Iterator[pa.RecordBatch], lot: int) -> Iterator[pa.ChunkedArray]:
    """Texts of about `lot` bytes, across batches."""
    held, size = [], 0
    for batch in batches:
        for part in chunks(batch, "text", lot):
            held.append(part.column("text"))
            size += part.nbytes
            if size >= lot:
                yield pa.chunked_array(held)
                held, size = [], 0
    if held:
        yield pa.chunked_array(held)


def expected_counts(sequences: DataFrame, model: Model, s: Settings = Settings(), shards: int = 1, most: int = 1_500_000) -> DataFrame:
    """(shard, h, c): packed hashes and expected counts of a task's words by shard, and in shard REST transitions by source state, first
    states, log likelihood and tokens."""
    emissions = Emissions(model, s)

    def rows(h: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        c = c.astype(np.float32)
        by = [(k, h[a:z].tobytes(), c[a:z].tobytes()) for k, a, z in _by_shard(h, shards)]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in by], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["shard", "h", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        moves, first, total, tokens = np.zeros((s.states, s.states)), np.zeros(s.states), 0.0, 0
        for batch in batches:
            for words, codes, active in zip(*(batch.column(k) for k in ("words", "codes", "active"))):
                h = np.frombuffer(words.as_py(), np.uint64)
                b, _ = emissions.of(h)
                counts = np.zeros((len(h), s.states))
                for code, n in zip(codes, active):
                    r = Run(np.frombuffer(code.as_py(), np.uint32).astype(np.int64), np.frombuffer(n.as_py(), np.uint32).astype(np.int64))
                    gamma, m, f, x = r.expected(b[r.word], model)
                    moves, first, total, tokens = moves + m, first + f, total + x, tokens + len(r.word)
                    for k in range(s.states):
                        counts[:, k] += np.bincount(r.word, gamma[:, k], len(h))
                parts.append((h, counts))
                held += len(h)
                if held > most:
                    parts = [_merged(parts)]
                    held = len(parts[0][0])
                    if held > most // 2:
                        yield from rows(*parts[0])
                        parts, held = [], 0
        if parts:
            yield from rows(*_merged(parts))
        rest = np.concatenate([moves.ravel(), first, [total, tokens]])
        yield pa.RecordBatch.from_arrays([pa.array([REST], pa.int32()), pa.array([b""], pa.binary()), pa.array([rest.tobytes()], pa.binary())], ["shard", "h", "c"])

    return sequences.select("words", "codes", "active").mapInArrow(run, "shard int, h binary, c binary")


def _added(s: Settings):
    """The arrays of each shard added up: known words and their counts, their number, totals by state, and those of rare words."""
    names = ["shard", "h", "c", "v", *(f"t{k}" for k in range(s.states)), *(f"u{k}" for k in range(s.states))]

    def row(shard: int, h: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        known = c.sum(1) >= s.least - 0.5
        numbers = [*c.sum(0).tolist(), *c[~known].sum(0).tolist()]
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([h[known].tobytes()]), pa.array([c[known].astype(np.float32).tobytes()]), pa.array([int(known.sum())], pa.int64()), *(pa.array([x]) for x in numbers)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, held, rest = None, [], 0, None
        for batch in batches:
            for shard, h, c in zip(*(batch.column(k) for k in ("shard", "h", "c"))):
                shard, c = shard.as_py(), c.as_py()
                if shard == REST:
                    rest = np.frombuffer(c) + (0 if rest is None else rest)
                    continue
                if shard != now and parts:
                    yield row(now, *_merged(parts))
                    parts, held = [], 0
                now = shard
                parts.append((np.frombuffer(h.as_py(), np.uint64), np.frombuffer(c, np.float32).reshape(-1, s.states)))
                held += len(parts[-1][0])
                if held > 1 << 21 and len(parts) > 8:  # what is added up already counts again, so wait until there is more
                    parts = [_merged(parts)]
                    held = 0
        if parts:
            yield row(now, *_merged(parts))
        if rest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([REST], pa.int32()), pa.array([b""]), pa.array([rest.tobytes()]), pa.array([0], pa.int64()), *(pa.array([0.0]) for _ in range(2 * s.states))], names)

    return run, "shard int, h binary, c binary, v long, " + ", ".join(f"{x}{k} double" for x in "tu" for k in range(s.states))


def trained(docs: DataFrame, s: Settings = Settings()) -> tuple[Model, list[float]]:
    """The trained model, and the log likelihood of the corpus under the model before each round; the first is that of the start, whose
    emissions are no probabilities."""
    if s.states < 2:
        raise ValueError("at least two states")
    spark = docs.sparkSession
    model, curve = initial(s), []
    folder = scratch_path(spark, "sequences")
    encoded(docs).write.option("compression", "zstd").parquet(folder)
    sequences = spark.read.schema("words binary, codes array<binary>, active array<binary>, distinct long").parquet(folder)
    distinct = sequences.agg(F.coalesce(F.sum("distinct"), F.lit(0))).head()[0]
    shards = 1 << max(0, -(-int(distinct) // s.shard_words) - 1).bit_length()
    add, schema = _added(s)
    ts, us = ([f"{x}{k}" for k in range(s.states)] for x in "tu")
    while not _ended(curve, model, s):
        parts = expected_counts(sequences, model, s, shards).repartition(shards, "shard").sortWithinPartitions("shard")
        table, now = written(parts.mapInArrow(add, schema), "hmm", ["shard"])
        t = table.agg(F.coalesce(F.sum("v"), F.lit(0)).alias("v"), *(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in (*ts, *us))).head()
        rest = np.frombuffer(table.where(F.col("shard") == REST).select("c").head()[0]) if not table.isEmpty() else np.zeros(s.states**2 + s.states + 2)
        if model.folder:
            removed(spark, model.folder)
        move = rest[: s.states**2].reshape(s.states, s.states) + s.smoothing
        first = rest[s.states**2 : -2] + s.smoothing
        model = Model(first / first.sum(), move / move.sum(1, keepdims=True), now, np.array([t[c] for c in ts]), np.array([t[c] for c in us]), int(t["v"]), shards, float(rest[-2]), int(rest[-1]))
        curve.append(model.log_likelihood)
        del parts, table
        spark.sparkContext._jvm.System.gc()  # the shuffle files of a round go when the driver has collected its plan
    removed(spark, folder)
    return model, curve


def _ended(curve: list[float], model: Model, s: Settings) -> bool:
    """The first gain is that over the emissions of the start, which aren't probabilities, and says nothing."""
    if s.rounds is not None:
        return len(curve) >= s.rounds
    return bool(curve) and model.tokens == 0 or len(curve) > 2 and curve[-1] - curve[-2] < s.tolerance * model.tokens


def scores(docs: DataFrame, model: Model, s: Settings = Settings()) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, perplexity) of every document."""
    emissions, lot = Emissions(model, s), (4 if model.words * (8 + 4 * s.states) <= s.held_bytes else 32) << 20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", lot):
                q = Sequences(part.column("text"))
                total = np.zeros(q.rows)
                if len(q.words):
                    b, _ = emissions.of(q.words)
                    for r, row in q.runs():
                        total += np.bincount(row, r.likelihoods(r.forward(b[r.word], model)[1]), q.rows)
                none = q.tokens == 0
                perplexity = np.exp(np.minimum(-total / np.maximum(q.tokens, 1), 700))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(q.tokens.astype(np.int64)), pa.array(total), pa.array(perplexity, mask=none)], ["doc_id", "n_tokens", "log_likelihood", "perplexity"])

    return _slim(docs).mapInArrow(run, "doc_id long, n_tokens long, log_likelihood double, perplexity double")


def corpus_scores(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Train on all documents and score each."""
    model = trained(docs, s)[0]
    out, _ = written(scores(docs, model, s), "hmm-scores")
    if model.folder:
        removed(docs.sparkSession, model.folder)
    return out
