"""Normaliser for WARC files that were compressed as a whole.

Such a file is one gzip stream, so a record can only be reached by inflating all before it. Each file is inflated once, as a
stream; every record becomes a gzip member of its own in a new file, and its offset and length go to a sidecar index beside that file
and to the returned table. A file is one task's work (a gzip stream can't be cut). A record passes through in pieces; what a
task holds is one header and up to `_HELD` bytes of a compressed member, beyond which the member waits in a side file, so that
memory doesn't depend on the length of a body or a file.

A new file's name is that of the old one, behind a hash of its whole path, so that files of the same name in different folders don't
meet.

Defined cases: an empty file gives an empty file and index; several members in a row are read as one stream; a stream that ends or
breaks inside a record keeps the records before it, and the rest is reported as one row of status "truncated" with no offset; bytes
that are no record are skipped up to the next line that begins one, and reported as one row of status "malformed" with no
offset; headers and bodies may have any length; a path that is given twice is one file; in `archive`, null urls and pages become
empty ones, a null page_id gets no id header; repeated rows become records each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import removed, scratch_path, written
from .arrays import chunks
from .files import Spool, Writing, opened, stream

SCHEMA = "path string, record int, offset long, length long, kind string, record_id string, uri string, content_length long, status string"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_TYPES = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
_PIECE = 1 << 18
_HELD = 32 << 20


def archive(pages: DataFrame, folder: str) -> DataFrame:
    """Write (page_id, url, html) as one monolithic .warc.gz a task; (path, records, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, n, size = f"{folder}/pages-{TaskContext.get().partitionId():06d}.warc.gz", 0, 0
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        with Writing(path) as out:

            def put(data: bytes) -> None:
                nonlocal size
                out.write(data)
                size += len(data)

            for batch in batches:
                for part in chunks(batch, "html"):
                    for page, url, html in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                        body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (html or "").encode()
                        name = f"WARC-Record-ID: <urn:page:{page}>\r\n" if page is not None else ""
                        uri = " ".join((url or "").split())
                        head = f"WARC/1.0\r\nWARC-Type: response\r\n{name}WARC-Target-URI: {uri}\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(body)}\r\n\r\n"
                        put(pack.compress(head.encode() + body + b"\r\n\r\n"))
                        n += 1
            put(pack.flush())
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return slim.mapInArrow(run, "path string, records long, bytes long")


def inflated(source) -> Iterator[bytes]:
    """The bytes of a gzip stream, whether of one member or many; raises zlib.error or EOFError where it breaks."""
    unpack, fed = zlib.decompressobj(31), False
    while raw := source.read(_PIECE):
        while raw:
            if unpack.eof:
                unpack = zlib.decompressobj(31)
            data = unpack.decompress(raw, 4 * _PIECE)
            fed = True
            if data:
                yield data
            raw = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
    if fed and not unpack.eof:
        raise EOFError


def records(blocks: Iterator[bytes]) -> Iterator[tuple[str, dict[str, str] | bytes | None]]:
    """The events of a WARC stream: ("begin", headers), ("data", bytes of header and body) and ("end", None) for each record,
    ("malformed", None) for bytes that were skipped, ("truncated", None) where the stream breaks off."""
    held = bytearray()

    def more() -> bool:
        data = next(blocks, None)
        if data is None:
            return False
        held.extend(data)
        return True

    def skipped() -> bool:
        """Drop what comes before the next line that begins a record."""
        at = 0
        while (at := held.find(b"\nWARC/", at)) < 0:
            del held[: max(0, len(held) - 5)]
            at = 0
            if not more():
                return False
        del held[: at + 1]
        return True

    try:
        while True:
            while not held or held[:1] in (b"\r", b"\n"):
                del held[:1]
                if not held and not more():
                    return
            while len(held) < 5 and more():
                pass
            looked, at = 0, -1
            while held[:5] == b"WARC/" and (at := held.find(b"\r\n\r\n", max(0, looked - 3))) < 0:
                looked = len(held)
                if not more():
                    yield "truncated", None
                    return
            head = bytes(held[: at + 4]) if at >= 0 else b""
            lines = head.decode("utf-8", "replace").split("\r\n")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}
            size = fields.get("content-length", "")
            if not (size.isascii() and size.isdigit()):
                yield "malformed", None
                if not skipped():
                    return
                continue
            yield "begin", fields
            yield "data", head
            del held[: at + 4]
            left = int(size)
            while left:
                if not held and not more():
                    yield "truncated", None
                    return
                n = min(left, len(held))
                yield "data", bytes(held[:n])
                del held[:n]
                left -= n
            yield "data", b"\r\n\r\n"
            yield "end", None
    except (zlib.error, EOFError):
        yield "truncated", None


def named(path: str) -> str:
    """The name of the file that a file becomes."""
    return f"{hashlib.sha256(path.encode()).hexdigest()[:16]}-{path.rpartition('/')[2]}"


def normalised(files: DataFrame, folder: str, level: int = 6, held: int = _HELD) -> DataFrame:
    """Rewrite each file of `path`, with one gzip member a record, into `folder`, a sidecar index beside it. The frame must be
    written once; a task that runs again writes the same files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                yield from _rewrite(path, f"{folder}/{named(path)}", level, held)

    paths = files.select("path").where("path is not null").distinct()
    n = max(1, paths.count())
    return paths.repartitionByRange(n, "path").mapInArrow(run, SCHEMA)


def _rewrite(path: str, to: str, level: int, held: int) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    at = number = 0
    with Writing(to) as out, Writing(f"{to}.idx") as index, stream(path) as source:
        member = Spool(f"{to}.{uuid.uuid4().hex[:8]}.part", held)  # so that a record that turns out broken leaves nothing in the file
        try:
            for event, value in records(inflated(source)):
                if event == "begin":
                    fields, pack = value, zlib.compressobj(level, zlib.DEFLATED, 31)
                    member.clear()
                elif event == "data":
                    member.write(pack.compress(value))
                elif event == "end":
                    member.write(pack.flush())
                    size = member.copy_to(out)
                    kind, name, uri = (fields.get(k) for k in ("warc-type", "warc-record-id", "warc-target-uri"))
                    rows.append((to, number, at, size, kind, name, uri, int(fields["content-length"]), "ok"))
                    index.write((json.dumps({"offset": at, "length": size, "type": kind, "id": name, "uri": uri}) + "\n").encode())
                    at, number = at + size, number + 1
                else:
                    rows.append((to, number, None, None, None, None, None, None, event))
                    number += 1
                if len(rows) >= 5000:
                    yield _batch(rows)
                    rows.clear()
        finally:
            member.clear()
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)


def fetched(index: DataFrame) -> DataFrame:
    """(record_id, uri, content_length, body_md5) of the sound records of an index, each read by its offset and inflated alone; the md5
    is that of the record's content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, f = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["path"] != path:
                    path, f = r["path"], opened(r["path"])
                f.seek(r["offset"])
                raw = zlib.decompressobj(31).decompress(f.read(r["length"]))
                body = raw[raw.index(b"\r\n\r\n") + 4 : -4]
                out.append((r["record_id"], r["uri"], len(body), hashlib.md5(body).hexdigest()))
            columns = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.string()))], ["record_id", "uri", "content_length", "body_md5"])

    return index.where("status = 'ok'").select("path", "offset", "length", "record_id", "uri").mapInArrow(run, "record_id string, uri string, content_length long, body_md5 string")


def _page() -> Column:
    page = F.regexp_extract("record_id", r"<urn:page:(-?\d+)>", 1)
    return F.when(page != "", page).cast("long").alias("page_id")


def _indexed(pages: DataFrame) -> tuple[DataFrame, list[str]]:
    spark = pages.sparkSession
    raw, to = scratch_path(spark, "warc"), scratch_path(spark, "warc-records")
    files, listed = written(archive(pages, raw), "warc-files")
    index, folder = written(normalised(files, to), "warc-index")
    for path in (raw, listed):
        removed(spark, path)
    return index, [to, folder]


def page_index(pages: DataFrame) -> DataFrame:
    """(page_id, file, record, offset, length, content_length, status, uri): pages archived as whole-file streams, then normalised. The
    new files and their sidecars stay, as the rows point into them."""
    index, _ = _indexed(pages)
    return index.select(_page(), F.element_at(F.split("path", "/"), -1).alias("file"), "record", "offset", "length", "content_length", "status", "uri")


def page_records(pages: DataFrame) -> DataFrame:
    """(page_id, uri, content_length, body_md5): every page as it is found again through the index."""
    index, folders = _indexed(pages)
    out, _ = written(fetched(index).select(_page(), "uri", "content_length", "body_md5"), "warc-found")
    for path in folders:
        removed(pages.sparkSession, path)
    return out
