"""Files in the shared folder, by URI, from the driver or any executor."""

from __future__ import annotations

import fnmatch
import uuid

import numpy as np
import pyarrow.fs as pafs


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI (file, hdfs, s3, gs ...) and the path in it; a bare path is local."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> None:
    fs, path = open_fs(uri)
    fs.create_dir(path, recursive=True)


def write_bytes(uri: str, parts) -> int:
    """Write the byte strings one after the other; a reader sees the whole file or none, and attempts do not meet."""
    fs, path = open_fs(uri)
    n, draft = 0, f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(draft) as out:
        for part in parts:
            out.write(part)
            n += len(part)
    fs.move(draft, path)
    return n


def read_text(uri: str) -> str | None:
    """A file's text; None if there is no such file."""
    fs, path = open_fs(uri)
    if fs.get_file_info(path).type != pafs.FileType.File:
        return None
    with fs.open_input_file(path) as f:
        return f.read().decode()


def list_files(uri: str) -> list[tuple[str, int]]:
    """(URI, bytes) of a file, of a folder's files, or of those of a folder that match a pattern in the last part of the
    URI; names that begin with a dot or an underscore are left out."""
    fs, path = open_fs(uri)
    scheme = uri[: len(uri) - len(path)] if uri.endswith(path) else ""
    folder, _, pattern = path.rpartition("/")
    if not any(c in pattern for c in "*?["):
        folder, pattern = path, "*"
        info = fs.get_file_info(path)
        if info.type == pafs.FileType.File:
            return [(scheme + path, info.size)]
    found = fs.get_file_info(pafs.FileSelector(folder or "."))
    return sorted((scheme + f.path, f.size) for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_")) and fnmatch.fnmatch(f.base_name, pattern))


def map_bytes(uri: str) -> np.ndarray:
    """A file's bytes: memory-mapped where the file system is local, else read."""
    fs, path = open_fs(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), np.uint8)
