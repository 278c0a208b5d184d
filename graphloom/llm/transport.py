"""MPEG transport streams in a media column: program tables, continuity, elementary streams, timestamps, random-access points.

`parsed` reads each stream as a matrix of 188-byte packets and works on whole columns of it: PIDs, continuity counters and payload
limits of all packets at once. Program association and map tables are joined from sections and checked by their CRC; packets
of an elementary stream become PES packets, whose payloads are stored one after the other with their sizes, presentation and decode
times (90 kHz, null where absent) and the numbers of those at which decoding may begin.

`muxed` builds such streams from texts, for tables that have no media of their own. Rows are independent; nothing is shuffled. Batches
are cut by bytes, not by rows, so that a task holds about `_LOT` bytes of media, or one longer medium, with its streams.

Defined cases: null or empty media, and media without a sound program table, give one row with null program and pid, in which
`packets` and `sync_errors` count what is there; a packet that doesn't begin with the sync byte is skipped until three in a row do; a
packet repeated once with the same counter and payload is a duplicate and counts once, its clock reference may differ; any other jump of a counter is an error, and PES
packets that it falls in are marked damaged; packets before a stream's first PES start are dropped, and counted; scrambled packets
give no payload; media of up to 2 GiB are parsed whole (Spark's binary values hold no more); an empty table gives an empty result; of
entries for the same program and stream the last wins; a null id stays null, repeated rows are parsed each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKET = 188
_LOT = 16 << 20
SCHEMA = (
    "media_id long, program int, pid int, stream_type int, packets int, continuity_errors int, duplicates int, dropped int, sync_errors int, "
    "pts array<long>, dts array<long>, random_access array<int>, sizes array<int>, damaged array<int>, data binary"
)
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_TYPES = [pa.int64(), *[pa.int32()] * 8, pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 3, pa.binary()]


def _crc_table() -> list[int]:
    out = []
    for k in range(256):
        c = k << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


@lru_cache(4096)  # tables are repeated many times a second
def crc32(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


# ---- writing


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32(head + body).to_bytes(4, "big")


def _stamp(mark: int, t: int) -> bytes:
    return bytes([mark << 4 | (t >> 29 & 0x0E) | 1, t >> 22 & 0xFF, (t >> 14 & 0xFE) | 1, t >> 7 & 0xFF, (t << 1 & 0xFE) | 1])


def pes(stream_id: int, data: bytes, pts: int | None, dts: int | None = None) -> bytes:
    times = b"" if pts is None else _stamp(2, pts) if dts is None else _stamp(3, pts) + _stamp(1, dts)
    size = len(data) + len(times) + 3
    return b"\x00\x00\x01" + bytes([stream_id]) + (size if size < 65536 else 0).to_bytes(2, "big") + bytes([0x80, (0 if pts is None else 0x80 if dts is None else 0xC0), len(times)]) + times + data


def packets(pid: int, data: bytes, counter: int, random_access: bool = False) -> list[bytes]:
    """The packets of one PES packet or section (with its pointer byte)."""
    out, at = [], 0
    while at < len(data) or not out:
        flags = 0x40 if not out and random_access else 0
        room = 184 - (2 if flags else 0)
        part = data[at : at + room]
        head = bytes([0x47, (0x40 if not out else 0) | pid >> 8, pid & 0xFF])
        fill = room - len(part)
        if flags or fill:
            length = 183 - len(part)
            field = bytes([length]) + (bytes([flags]) + b"\xff" * (length - 1) if length else b"")
            out.append(head + bytes([0x30 | (counter + len(out)) & 15]) + field + part)
        else:
            out.append(head + bytes([0x10 | (counter + len(out)) & 15]) + part)
        at += len(part)
    return out


def mux(video: bytes, audio: bytes, unit: int = 1024, group: int = 12) -> bytes:
    """One program: `video` in access units of `unit` bytes, each `group`-th a random-access point, `audio` in one unit for each group."""
    pat = b"\x00" + _section(0, 1, b"\x00\x01" + (0xE000 | 0x100).to_bytes(2, "big"))
    streams = b"".join(bytes([kind]) + (0xE000 | pid).to_bytes(2, "big") + b"\xf0\x00" for kind, pid in ((0x1B, 0x101), (0x0F, 0x102)))
    pmt = b"\x00" + _section(2, 1, (0xE000 | 0x101).to_bytes(2, "big") + b"\xf0\x00" + streams)
    counters, out = {0: 0, 0x100: 0, 0x101: 0, 0x102: 0}, []

    def put(pid: int, data: bytes, access: bool = False) -> None:
        got = packets(pid, data, counters[pid], access)
        counters[pid] += len(got)
        out.extend(got)

    units = [video[k : k + unit] for k in range(0, len(video), unit)]
    groups = max(1, -(-len(units) // group))
    share = -(-len(audio) // groups)
    for g in range(groups):
        put(0, pat)
        put(0x100, pmt)
        for k, data in enumerate(units[g * group : (g + 1) * group], g * group):
            time = 90_000 + k * 3600
            put(0x101, pes(0xE0, data, time + 7200, time), k % group == 0)
        if sound := audio[g * share : (g + 1) * share]:
            put(0x102, pes(0xC0, sound, 90_000 + g * group * 3600))
    return b"".join(out)


def lots(batch: pa.RecordBatch, columns: tuple[str, ...], most: int = _LOT) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about `most` bytes in these columns; a longer row is a run of its own."""
    total = np.cumsum(sum(pc.fill_null(pc.binary_length(batch.column(c)).cast(pa.int64()), 0).to_numpy(zero_copy_only=False) for c in columns))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def muxed(rows: DataFrame, video: str, audio: str, key: str) -> DataFrame:
    """(media_id, media): a stream for each row, the bytes of two text columns as its video and audio."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in lots(batch, ("v", "a")):
                media = [mux((v or "").encode(), (a or "").encode()) for v, a in zip(part.column("v").to_pylist(), part.column("a").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("media_id"), pa.array(media, pa.binary())], ["media_id", "media"])

    return rows.select(F.col(key).cast("long").alias("media_id"), F.col(video).cast("string").alias("v"), F.col(audio).cast("string").alias("a")).mapInArrow(run, "media_id long, media binary")


# ---- reading


def aligned(raw: bytes) -> tuple[np.ndarray, int]:
    """The stream as rows of packets, and the number of places where the sync was lost."""
    data = np.frombuffer(raw, np.uint8)
    whole = len(data) // PACKET * PACKET
    rows = data[:whole].reshape(-1, PACKET)
    if len(rows) and (rows[:, 0] == 0x47).all() and whole == len(data):
        return rows, 0
    out, at, lost = [], 0, 0
    while at + PACKET <= len(data):
        n = (len(data) - at) // PACKET
        good = data[at : at + n * PACKET].reshape(-1, PACKET)[:, 0] == 0x47
        run = n if good.all() else int(np.argmin(good))
        if run:
            out.append(data[at : at + run * PACKET].reshape(-1, PACKET))
            at += run * PACKET
        if at >= len(data):
            break
        lost += 1
        # the next place where as many of three packets in a row as still fit begin with the sync byte
        places = np.flatnonzero(data[at + 1 :] == 0x47) + at + 1
        for step in (PACKET, 2 * PACKET):
            places = places[(places + step >= len(data)) | (data[np.minimum(places + step, len(data) - 1)] == 0x47)]
        places = places[places + PACKET <= len(data)]
        if not len(places):
            break
        at = int(places[0])
    return np.concatenate(out) if out else rows[:0], lost


class Packets:
    """Header fields of all packets of a stream."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        b1, b3 = rows[:, 1].astype(np.int32), rows[:, 3].astype(np.int32)
        self.pid = (b1 & 0x1F) << 8 | rows[:, 2]
        self.begins = (b1 & 0x40) > 0
        self.counter = b3 & 15
        adapted, self.loaded = (b3 & 0x20) > 0, ((b3 & 0x10) > 0) & ((b3 & 0xC0) == 0) & ((b1 & 0x80) == 0)
        length = np.where(adapted, rows[:, 4], 0)
        self.flags = np.where(adapted & (length > 0), rows[:, 5], 0)
        self.start = np.minimum(4 + adapted + length, PACKET)
        self.start[~self.loaded] = PACKET

    def of(self, pid: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Packets of a PID without duplicates, which of them come after a jump of the counter, and the number of duplicates."""
        at = np.flatnonzero((self.pid == pid) & self.loaded)
        if len(at) < 2:
            return at, np.zeros(len(at), bool), 0
        step = (self.counter[at[1:]] - self.counter[at[:-1]]) & 15
        repeat = np.zeros(len(at), bool)
        for k in np.flatnonzero(step == 0) + 1:
            repeat[k] = not repeat[k - 1] and self._same(at[k], at[k - 1])
        copies = int(repeat.sum())
        at = at[~repeat]
        step = (self.counter[at[1:]] - self.counter[at[:-1]]) & 15
        jump = np.zeros(len(at), bool)
        jump[1:] = (step != 1) & ((self.flags[at[1:]] & 0x80) == 0)
        return at, jump, copies

    def _same(self, a: int, b: int) -> bool:
        """Whether two packets are copies; a copy carries a clock reference of its own."""
        same = self.rows[a, 3:] == self.rows[b, 3:]
        if self.flags[a] & self.flags[b] & 0x10:
            same[3:9] = True
        return bool(same.all())

    def payload(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Payload bytes of some packets one after the other, and how many each has."""
        rows, start = self.rows[at], self.start[at]
        return rows[np.arange(PACKET) >= start[:, None]], PACKET - start

    def sections(self, pid: int) -> Iterator[bytes]:
        at, jump, _ = self.of(pid)
        data, size = self.payload(at)
        held, end = b"", 0
        for k, n in enumerate(size.tolist()):
            part, end = data[end : end + n].tobytes(), end + n
            if jump[k]:
                held = b""
            if self.begins[at[k]] and part:
                pointer = part[0]
                yield from _sections(held + part[1 : 1 + pointer] if held else b"")
                held = part[1 + pointer :]
            elif held:
                held += part
        yield from _sections(held)


def _sections(data: bytes) -> Iterator[bytes]:
    while len(data) >= 3 and data[0] != 0xFF:
        size = 3 + (int.from_bytes(data[1:3], "big") & 0xFFF)
        if len(data) < size:
            return
        if size >= 12 and crc32(data[:size]) == 0:
            yield data[:size]
        data = data[size:]


def programs(p: Packets) -> list[tuple[int, int, int]]:
    """(program, pid, stream type) of all elementary streams, from the tables that are current."""
    maps = {}
    for s in p.sections(0):
        if s[0] == 0 and s[5] & 1:
            for k in range(8, len(s) - 4, 4):
                number = int.from_bytes(s[k : k + 2], "big")
                if number:
                    maps[number] = int.from_bytes(s[k + 2 : k + 4], "big") & 0x1FFF
    out = {}
    for number, pid in sorted(maps.items()):
        for s in p.sections(pid):
            if s[0] != 2 or not s[5] & 1 or int.from_bytes(s[3:5], "big") != number:
                continue
            k = 12 + (int.from_bytes(s[10:12], "big") & 0xFFF)
            while k + 5 <= len(s) - 4:
                out[number, int.from_bytes(s[k + 1 : k + 3], "big") & 0x1FFF] = s[k]
                k += 5 + (int.from_bytes(s[k + 3 : k + 5], "big") & 0xFFF)
    return [(n, pid, kind) for (n, pid), kind in sorted(out.items())]


def _time(b: bytes) -> int:
    return (b[0] & 0x0E) << 29 | b[1] << 22 | (b[2] & 0xFE) << 14 | b[3] << 7 | b[4] >> 1


def elementary(p: Packets, pid: int) -> dict:
    at, jump, copies = p.of(pid)
    first = np.flatnonzero(p.begins[at])
    dropped = int(first[0]) if len(first) else len(at)
    errors = int(jump.sum())
    data, size = p.payload(at)
    edge = np.concatenate([[0], np.cumsum(size)])
    raw, jumps = data.tobytes(), np.concatenate([[0], np.cumsum(jump)])
    pts, dts, access, sizes, damaged, body = [], [], [], [], [], []
    for k, (a, z) in enumerate(zip(first.tolist(), [*first[1:].tolist(), len(at)])):
        part = raw[edge[a] : edge[z]]
        if len(part) < 6 or part[:3] != b"\x00\x00\x01":
            pts.append(None), dts.append(None), sizes.append(0), damaged.append(k)
            continue
        begin, times = 6, (None, None)
        if part[3] not in (0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF) and len(part) >= 9:
            begin = 9 + part[8]
            if part[7] & 0x80 and part[8] >= 5 and len(part) >= 14:
                times = (_time(part[9:14]), _time(part[14:19]) if part[7] & 0x40 and part[8] >= 10 and len(part) >= 19 else None)
        told = int.from_bytes(part[4:6], "big")
        content = part[begin : 6 + told] if told else part[begin:]
        # a jump at the first packet lies before this PES packet
        if jumps[z] > jumps[a + 1] or told and len(part) < 6 + told:
            damaged.append(k)
        pts.append(times[0]), dts.append(times[1]), sizes.append(len(content)), body.append(content)
        if p.flags[at[a]] & 0x40:
            access.append(k)
    return {"packets": len(at), "continuity_errors": errors, "duplicates": copies, "dropped": dropped, "pts": pts, "dts": dts, "random_access": access, "sizes": sizes, "damaged": damaged, "data": b"".join(body)}


def parse(raw: bytes | None) -> list[dict]:
    rows, lost = aligned(raw or b"")
    p = Packets(rows)
    out = [{"program": n, "pid": pid, "stream_type": kind, "sync_errors": lost} | elementary(p, pid) for n, pid, kind in programs(p)]
    return out or [{"packets": len(rows), "sync_errors": lost}]


def parsed(media: DataFrame) -> DataFrame:
    """One row for each elementary stream of (media_id, media)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in lots(batch, ("media",)):
                rows = [{"media_id": k} | r for k, raw in zip(part.column("media_id").to_pylist(), part.column("media").to_pylist()) for r in parse(raw)]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(_NAMES, _TYPES)], _NAMES)

    return media.select(F.col("media_id").cast("long").alias("media_id"), F.col("media").cast("binary").alias("media")).mapInArrow(run, SCHEMA)
