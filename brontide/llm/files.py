"""Files of raw arrays in the shared folder, written and read by tasks."""

from __future__ import annotations

import re
import uuid
from urllib.parse import unquote

import numpy as np
import pyarrow.fs as pafs

_open: dict[str, np.ndarray | None] = {}


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), unquote(re.sub("^file:/+", "/", path))
    if "://" not in path:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


def write_file(path: str, data: bytes) -> None:
    """Write whole and then name it, so that readers and repeated attempts never meet a part of a file."""
    fs, name = _place(path)
    fs.create_dir(name.rpartition("/")[0], recursive=True)
    part = f"{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, name)


def read_file(path: str) -> bytes:
    fs, name = _place(path)
    with fs.open_input_stream(name) as f:
        return f.read()


def mapped(path: str) -> np.ndarray | None:
    """The file's bytes, memory-mapped where the shared folder is mounted, read once by each worker elsewhere; None if there is no such file."""
    if path not in _open:
        if len(_open) > 400:  # each keeps a file open
            _open.clear()
        fs, name = _place(path)
        if fs.get_file_info(name).type == pafs.FileType.NotFound:
            _open[path] = None
        elif isinstance(fs, pafs.LocalFileSystem):
            size = fs.get_file_info(name).size
            _open[path] = np.memmap(name, np.uint8, "r") if size else np.zeros(0, np.uint8)
        else:
            _open[path] = np.frombuffer(read_file(path), np.uint8)
    return _open[path]
