"""Binary files that tasks write and read below the shared folder, by path or URI."""

from __future__ import annotations

import numpy as np
from pyarrow import fs


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (file, hdfs, s3, gs), and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def make_folder(path: str) -> None:
    system, inner = place(path)
    system.create_dir(inner, recursive=True)


def open_out(path: str):
    system, inner = place(path)
    return system.open_output_stream(inner, buffer_size=1 << 20, compression=None)


def open_in(path: str):
    system, inner = place(path)
    return system.open_input_file(inner)


def array_of(path: str, dtype: str) -> np.ndarray:
    """A file of fixed-size values: memory-mapped on a mounted file system, else read."""
    system, inner = place(path)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(inner, dtype=dtype, mode="r") if system.get_file_info(inner).size else np.empty(0, dtype=dtype)
    with system.open_input_file(inner) as file:
        return np.frombuffer(file.read(), dtype=dtype)
