"""Files in the shared folder as Python tasks see them: written once under a name of the attempt, read by ranges."""

from __future__ import annotations

import uuid
from functools import cache

import pyarrow.fs as pafs


@cache
def _system(start: str) -> pafs.FileSystem:
    return pafs.LocalFileSystem() if start == "file:" else pafs.FileSystem.from_uri(start)[0]


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI, and the path in it. Without a scheme it is a local path."""
    scheme, colon, rest = uri.partition(":")
    if not colon or scheme == "file":
        return _system("file:"), "/" + (rest if colon else uri).lstrip("/")
    start = "/".join(uri.split("/", 3)[:3])
    return _system(start + "/"), pafs.FileSystem.from_uri(uri)[1]


def make_folder(uri: str) -> str:
    system, path = place(uri)
    system.create_dir(path, recursive=True)
    return uri


class Writer:
    """A new file in a folder. Its name is the attempt's own, so that a task that is run again never writes into what a
    lost one has left; only names that a finished task gave on are read."""

    def __init__(self, folder: str, suffix: str):
        self.name = f"{uuid.uuid4().hex}{suffix}"
        system, path = place(f"{folder}/{self.name}")
        self.stream, self.size = system.open_output_stream(path, compression=None), 0

    def write(self, data: bytes) -> int:
        """Where the data begins."""
        at = self.size
        self.stream.write(data)
        self.size += len(data)
        return at

    def close(self) -> None:
        self.stream.close()


class Reader:
    """Ranges of files in a folder; the last file stays open."""

    def __init__(self, folder: str):
        self.folder, self.name, self.file = folder, None, None

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        if name != self.name:
            self.close()
            system, path = place(f"{self.folder}/{name}")
            self.name, self.file = name, system.open_input_file(path)
        return self.file.read_at(self.file.size() if length is None else length, offset)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.name = self.file = None
