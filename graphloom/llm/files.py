"""Files in the shared folder, read and written from executors through Arrow's file systems."""

from __future__ import annotations

import uuid

from pyarrow import fs


def _system(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def opened(uri: str):
    system, path = _system(uri)
    return system.open_input_file(path)


def stream(uri: str):
    system, path = _system(uri)
    return system.open_input_stream(path, compression=None)


class Writing:
    """A file that appears under its name only when it is whole, so that a task that runs twice leaves one file."""

    def __init__(self, uri: str):
        self.system, self.path = _system(uri)
        self.temporary = f"{self.path}.{uuid.uuid4().hex[:8]}.tmp"
        self.system.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.system.open_output_stream(self.temporary, compression=None)

    def __enter__(self):
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is None:
            self.system.move(self.temporary, self.path)
        else:
            self.system.delete_file(self.temporary)


class Spool:
    """Bytes in memory up to a bound, in a file of the shared folder beyond it."""

    def __init__(self, uri: str, most: int):
        self.system, self.path = _system(uri)
        self.most, self.parts, self.size, self.file = most, [], 0, None

    def write(self, data: bytes) -> None:
        self.parts.append(data)
        self.size += len(data)
        if self.size > self.most:
            self.file = self.file or self.system.open_output_stream(self.path, compression=None)
            self._drain(self.file)

    def _drain(self, out) -> None:
        for part in self.parts:
            out.write(part)
        self.parts, self.size = [], 0

    def copy_to(self, out) -> int:
        """Append all to a stream, and begin anew."""
        total = self.size
        if self.file:
            self._drain(self.file)
            self.file.close()
            with self.system.open_input_stream(self.path, compression=None) as f:
                while data := f.read(1 << 20):
                    out.write(data)
            total = self.system.get_file_info(self.path).size
        self._drain(out)
        self.clear()
        return total

    def clear(self) -> None:
        if self.file:
            self.file.close()
            self.system.delete_file(self.path)
        self.parts, self.size, self.file = [], 0, None
