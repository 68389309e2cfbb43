"""Shared working folders and plain file access from driver and executors."""

from __future__ import annotations

import uuid

from regionfx.storage import discard, materialize, new_folder, shared_root

__all__ = ["discard", "materialize", "new_folder", "open_filesystem", "shared_root", "write_bytes"]


def open_filesystem(uri: str):
    """(filesystem, path) of pyarrow for a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_bytes(uri: str, chunks) -> int:
    """Write the byte chunks to ``uri`` by way of an own temporary name, so that a repeated task replaces whole files."""
    filesystem, path = open_filesystem(uri)
    filesystem.create_dir(path.rsplit("/", 1)[0], recursive=True)
    temporary, n = f"{path}.{uuid.uuid4().hex}.tmp", 0
    with filesystem.open_output_stream(temporary) as out:
        for chunk in chunks:
            out.write(chunk)
            n += len(chunk)
    filesystem.move(temporary, path)
    return n
