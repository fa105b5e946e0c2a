"""Byte files in the folder that all executors share, on whatever file system it is."""

from __future__ import annotations

import posixpath
from functools import cache

from pyarrow import fs


@cache
def _system(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if ":" in root.split("/", 1)[0] else (fs.LocalFileSystem(), root)


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    head, _, tail = uri.partition("://")
    if not tail:
        head, _, tail = uri.partition(":")
        if head == "file":
            return fs.LocalFileSystem(), "/" + tail.lstrip("/")
        return _system(uri)[0], uri
    if head == "file":
        return fs.LocalFileSystem(), "/" + tail.partition("/")[2] if not tail.startswith("/") else tail
    host, _, path = tail.partition("/")
    return _system(f"{head}://{host}/")[0], "/" + path


class NewFile:
    """Writes beside the final name and moves there at the end, so that a lost attempt leaves no half file under it."""

    def __init__(self, folder: str, name: str, attempt: str):
        self.system, root = place(folder)
        self.system.create_dir(root, recursive=True)
        self.path, self.part = posixpath.join(root, name), posixpath.join(root, f"_{name}.{attempt}")
        self.stream = self.system.open_output_stream(self.part, compression=None)
        self.size = 0

    def write(self, data: bytes) -> int:
        """Appends; gives the offset at which the data begin."""
        at = self.size
        self.stream.write(data)
        self.size += len(data)
        return at

    def close(self) -> None:
        self.stream.close()
        self.system.move(self.part, self.path)


def open_file(folder: str, name: str):
    system, root = place(folder)
    return system.open_input_file(posixpath.join(root, name))
