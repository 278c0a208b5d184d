import numpy as np
import pyarrow as pa

from graphloom.llm import transport as ts

VIDEO, AUDIO = bytes(range(256)) * 60, b"sound" * 500


def cut(raw):
    return [raw[k : k + 188] for k in range(0, len(raw), 188)]


def streams(raw):
    return {r.get("pid"): r for r in ts.parse(raw)}


def test_round_trip():
    got = streams(ts.mux(VIDEO, AUDIO, unit=1000, group=5))
    v, a = got[0x101], got[0x102]
    assert v["data"] == VIDEO and a["data"] == AUDIO
    assert v["sizes"] == [1000] * 15 + [360] and v["random_access"] == [0, 5, 10, 15]
    assert v["dts"] == [90_000 + 3600 * k for k in range(16)] and v["pts"] == [x + 7200 for x in v["dts"]]
    assert a["dts"] == [None] * 4 and (v["program"], v["stream_type"], a["stream_type"]) == (1, 0x1B, 0x0F)
    assert not any(x[k] for x in got.values() for k in ("continuity_errors", "duplicates", "dropped", "sync_errors")) and not v["damaged"]


def test_a_lost_packet_is_an_error():
    raw = cut(ts.mux(VIDEO, AUDIO))
    video = [k for k, p in enumerate(raw) if ((p[1] & 31) << 8 | p[2]) == 0x101]
    del raw[video[3]]
    got = streams(b"".join(raw))[0x101]
    assert (got["continuity_errors"], got["damaged"]) == (1, [0])


def test_a_repeated_packet_counts_once():
    raw = cut(ts.mux(VIDEO, AUDIO))
    video = [k for k, p in enumerate(raw) if ((p[1] & 31) << 8 | p[2]) == 0x101]
    raw.insert(video[2], raw[video[2]])
    got = streams(b"".join(raw))[0x101]
    assert (got["duplicates"], got["continuity_errors"], got["data"]) == (1, 0, VIDEO)


def test_a_copy_may_have_its_own_clock_reference():
    def packet(clock, payload):
        return bytes([0x47, 0x01, 0x01, 0x35, 7, 0x10]) + clock + payload * 176

    rows = [packet(b"\0\0\0\0\x7e\0", b"a"), packet(b"\0\0\0\1\x7e\0", b"a"), packet(b"\0\0\0\2\x7e\0", b"b")]
    p = ts.Packets(np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 188))
    at, jump, copies = p.of(0x101)
    assert (at.tolist(), jump.tolist(), copies) == ([0, 2], [False, True], 1)


def test_tables_written_by_others():
    """Program tables as a common muxer writes them, then packets put together by hand."""
    pat = bytes.fromhex("474000100000b00d0001c100000001f0002ab104b2").ljust(188, b"\xff")
    pmt = bytes.fromhex("475000100002b0170001c10000e100f0001be100f0000fe101f0002f44b99b").ljust(188, b"\xff")
    times = bytes.fromhex("310007d861" + "110007a981")  # 33-bit times in three parts with marker bits: 126,000 and 120,000
    video = bytes.fromhex("47410030") + bytes([183 - 25, 0x50]) + bytes.fromhex("00003a980000") + b"\xff" * (183 - 25 - 7) + bytes.fromhex("000001e0000080c00a") + times + b"frame!"
    audio = bytes.fromhex("47410130") + bytes([183 - 16, 0]) + b"\xff" * (183 - 16 - 1) + bytes.fromhex("000001c0000a808005") + bytes.fromhex("210007d861") + b"ab"
    assert {len(x) for x in (pat, pmt, video, audio)} == {188}
    got = streams(pat + pmt + video + audio)
    assert (got[0x100]["stream_type"], got[0x101]["stream_type"], got[0x100]["program"]) == (0x1B, 0x0F, 1)
    assert (got[0x100]["data"], got[0x100]["pts"], got[0x100]["dts"], got[0x100]["random_access"]) == (b"frame!", [126_000], [120_000], [0])
    assert (got[0x101]["data"], got[0x101]["pts"], got[0x101]["dts"], got[0x101]["damaged"]) == (b"ab", [126_000], [None], [])


def test_batches_are_cut_by_bytes():
    batch = pa.RecordBatch.from_pydict({"media": [b"x" * 10, None, b"y" * 25, b"", b"z" * 10, b"w"]})
    assert [part.num_rows for part in ts.lots(batch, ("media",), 20)] == [2, 1, 3]


def test_sync_is_found_again():
    raw = cut(ts.mux(VIDEO, AUDIO))
    got = streams(b"junk" + b"".join(raw))
    assert got[0x101]["data"] == VIDEO and got[0x101]["sync_errors"] == 1


def test_packets_before_the_first_start_are_dropped():
    raw = cut(ts.mux(VIDEO, b""))
    first = next(k for k, p in enumerate(raw) if ((p[1] & 31) << 8 | p[2]) == 0x101)
    del raw[first]
    assert streams(b"".join(raw))[0x101]["dropped"] == 5


def test_broken_table_gives_no_program():
    raw = bytearray(ts.mux(VIDEO, b""))
    raw[187] ^= 1  # the CRC of the first association table; it comes again with the second group
    assert streams(bytes(raw))[0x101]["data"] == VIDEO
    one = bytearray(ts.mux(VIDEO[:100], b""))
    one[187] ^= 1
    assert ts.parse(bytes(one)) == [{"packets": len(one) // 188, "sync_errors": 0}]


def test_odd_rows(spark):
    page = spark.createDataFrame([(1, "u", "h", 9), (1, "u", "h", 9), (2, None, None, 9), (None, "", "x" * 3_000_000, 9)], "page_id long, url string, html string, pid int")
    got = ts.parsed(ts.muxed(page, "html", "url", "page_id")).collect()
    assert sum(r.media_id == 1 for r in got) == 4 and len([r for r in got if r.media_id == 2]) == 2
    assert max(len(r.data) for r in got if r.media_id is None) == 3_000_000
    raw = spark.createDataFrame([(1, None), (2, b""), (3, b"G"), (4, bytes(np.full(1000, 7, np.uint8)))], "media_id long, media binary")
    got = {r.media_id: r for r in ts.parsed(raw).collect()}
    assert all(r.program is None and r.packets == 0 for r in got.values()) and got[4].sync_errors == 1
    assert ts.parsed(raw.where("false")).collect() == []


def test_pages_come_back(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = ts.parsed(ts.muxed(pages, "html", "url", "page_id")).where("pid = 257").collect()
    assert {r.media_id: bytes(r.data).decode() for r in got} == {r.page_id: r.html for r in pages.collect()}
