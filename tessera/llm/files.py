"""Byte files on any file system that the executors reach: local (shared) paths directly, others by pyarrow.

A file is written under another name and renamed, so a task that is run again, or
twice at once, leaves either nothing or the whole file.
"""

from __future__ import annotations

import os
import uuid

import numpy as np


def local(path: str) -> str | None:
    """The plain path of a file: URI; None for another file system."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if "://" not in path else None


class Writer:
    def __init__(self, path: str):
        self.path, self.at = path, local(path)
        self.part = f"{path}.{uuid.uuid4().hex}.part"
        if self.at is not None:
            os.makedirs(os.path.dirname(self.at), exist_ok=True)
            self.out = open(local(self.part), "wb")  # noqa: SIM115
        else:
            from pyarrow import fs

            self.fs, inner = fs.FileSystem.from_uri(self.part)
            self.inner, self.out = inner, self.fs.open_output_stream(inner)

    def write(self, data: bytes | memoryview) -> None:
        self.out.write(data)

    def close(self) -> None:
        self.out.close()
        if self.at is not None:
            os.replace(local(self.part), self.at)
        else:
            self.fs.move(self.inner, self.inner[: -len(self.part) + len(self.path)])


def read_array(path: str, dtype: np.dtype) -> np.ndarray:
    """The file as an array: memory-mapped where it is a local file."""
    at = local(path)
    if at is not None:
        return np.memmap(at, dtype=dtype, mode="r") if os.path.getsize(at) else np.zeros(0, dtype=dtype)
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    with system.open_input_file(inner) as f:
        return np.frombuffer(f.read(), dtype=dtype)


def reader(path: str, dtype: np.dtype):
    """A function that gives the file's values a to b, mapped or read as they are asked for."""
    at, size = local(path), np.dtype(dtype).itemsize
    if at is not None:
        whole = read_array(path, dtype)
        return lambda a, b: whole[a:b]
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)

    def read(a: int, b: int) -> np.ndarray:
        with system.open_input_file(inner) as f:
            f.seek(a * size)
            return np.frombuffer(f.read((b - a) * size), dtype=dtype)

    return read
