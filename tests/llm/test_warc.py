import gzip
import hashlib
import json
import zlib

import pytest

from graphloom.llm import warc


def record(n, body=b"body"):
    return b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: %d\r\n\r\n" % (n, len(body)) + body + b"\r\n\r\n"


def normalised(spark, tmp_path, raw, held=1 << 20):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.gz").write_bytes(raw)
    files = spark.createDataFrame([(str(tmp_path / "in" / "a.warc.gz"),)], "path string")
    rows = warc.normalised(files, str(tmp_path / "out"), held=held).collect()
    out = tmp_path / "out" / warc.named(str(tmp_path / "in" / "a.warc.gz"))
    assert sorted(f.name for f in (tmp_path / "out").iterdir()) == [out.name, f"{out.name}.idx"]
    return sorted(rows, key=lambda r: r.record), out.read_bytes(), out.with_name(f"{out.name}.idx").read_text()


BODIES = [b"one", b"", b"WARC/1.0\r\n\r\n" * 50, b"x" * 2_000_000, b"\r\n\r\n"]


@pytest.mark.parametrize("members, held", [(1, 1 << 20), (2, 100), (5, 0)])
def test_every_record_is_a_member(spark, tmp_path, members, held):
    records = [record(k, b) for k, b in enumerate(BODIES)]
    raw = b"".join(gzip.compress(b"".join(records[k::1][: len(records)] if members == 1 else records[k * 5 // members : (k + 1) * 5 // members])) for k in range(members))
    rows, data, index = normalised(spark, tmp_path, raw, held)
    assert [r.status for r in rows] == ["ok"] * 5
    assert [gzip.decompress(data[r.offset : r.offset + r.length]) for r in rows] == records
    assert gzip.decompress(data) == b"".join(records)
    assert [(x["offset"], x["length"]) for x in map(json.loads, index.splitlines())] == [(r.offset, r.length) for r in rows]


def test_truncated(spark, tmp_path):
    raw = gzip.compress(record(1) + record(2, bytes(range(256)) * 999))
    rows, data, _ = normalised(spark, tmp_path, raw[:-300])
    assert [(r.status, r.offset) for r in rows] == [("ok", 0), ("truncated", None)]
    assert gzip.decompress(data) == record(1)


@pytest.mark.parametrize("junk", [b"no header\r\n\r\n", b"WARC/1.0\r\nno length\r\n\r\nbody\r\n\r\n", b"\0" * 700_000 + b"\r\n"])
def test_malformed_bytes_are_skipped(spark, tmp_path, junk):
    rows, data, _ = normalised(spark, tmp_path, gzip.compress(record(1) + junk + record(2) + record(3)))
    assert [r.status for r in rows] == ["ok", "malformed", "ok", "ok"] and gzip.decompress(data) == record(1) + record(2) + record(3)
    rows, data, _ = normalised(spark, tmp_path / "end", gzip.compress(record(1) + junk)) if (tmp_path / "end").mkdir() is None else None
    assert [r.status for r in rows] == ["ok", "malformed"] and gzip.decompress(data) == record(1)


def test_headers_of_any_length(spark, tmp_path):
    long = record(2).replace(b"WARC-Type", b"X-Long: " + b"h" * 3_000_000 + b"\r\nWARC-Type")
    rows, data, _ = normalised(spark, tmp_path, gzip.compress(record(1) + long + record(3)))
    assert [r.status for r in rows] == ["ok"] * 3 and gzip.decompress(data) == record(1) + long + record(3)


def test_files_of_one_name_stay_apart(spark, tmp_path):
    paths = []
    for k, folder in enumerate("ab"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.warc.gz").write_bytes(gzip.compress(record(k)))
        paths.append((str(tmp_path / folder / "x.warc.gz"),))
    got = warc.normalised(spark.createDataFrame(paths + paths[:1], "path string"), str(tmp_path / "out")).collect()
    assert len({r.path for r in got}) == len(got) == 2
    for r in got:
        with open(r.path, "rb") as f:
            assert gzip.decompress(f.read()) == record(int(r.record_id[len("<urn:page:") : -1]))


@pytest.mark.parametrize("raw", [b"", gzip.compress(b"")])
def test_empty(spark, tmp_path, raw):
    assert normalised(spark, tmp_path, raw) == ([], b"", "")


def test_not_gzip(spark, tmp_path):
    assert [r.status for r in normalised(spark, tmp_path, b"plain bytes")[0]] == ["truncated"]


def test_records_are_found_through_the_index(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    want = sorted((r.page_id, r.url, len(body := head + r.html.encode()), hashlib.md5(body).hexdigest()) for r in pages.collect())
    assert sorted(tuple(r) for r in warc.page_records(pages).collect()) == want


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = f"{warc.scratch_path(spark, 'test')}"
    files, _ = warc.written(warc.archive(pages, folder), "test-files")
    for f in files.collect():
        assert zlib.decompressobj(31).decompress(open(f.path.replace("file:", ""), "rb").read())  # one member
    want = {r.page_id: r.html for r in pages.collect()}
    index, _ = warc.written(warc.normalised(files, folder + "-out"), "test-index")
    seen = {}
    for r in index.collect():
        with open(r.path.replace("file:", ""), "rb") as f:
            f.seek(r.offset)
            text = gzip.decompress(f.read(r.length))
        seen[int(r.record_id[len("<urn:page:") : -1])] = text.split(b"\r\n\r\n", 2)[2][:-4].decode()
    assert seen == want


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, None, 1), (1, None, None, 1), (None, "a b\nc", "x", 2), (3, "", "y" * 3_000_000, 3)], "page_id long, url string, html string, record int")
    got = sorted(warc.page_index(pages).collect(), key=lambda r: (r.page_id is None, r.page_id or 0))
    assert [r.page_id for r in got] == [1, 1, 3, None] and got[3].uri == "a b c" and got[2].content_length > 3_000_000
    assert warc.page_index(pages.where("false")).collect() == []
