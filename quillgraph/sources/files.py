"""Single files in a folder that all executors share, on whatever file system it is."""

from __future__ import annotations

import posixpath
import uuid

from pyarrow import fs


def write_once(folder: str, name: str, data: bytes) -> str:
    """Write a file that doesn't exist yet: beside its name, then moved there, so that it is never seen half. Gives its path."""
    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    system, root = fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)
    system.create_dir(root, recursive=True)
    path = posixpath.join(root, name)
    if system.get_file_info(path).type == fs.FileType.NotFound:
        part = posixpath.join(root, f"_{name}.{uuid.uuid4().hex}")
        with system.open_output_stream(part) as out:
            out.write(data)
        system.move(part, path)
    return path
