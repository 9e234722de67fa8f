"""Plain files in the shared folder, written and read by tasks."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

import numpy as np


def local_path(path: str) -> str | None:
    """The path as this machine mounts it; None if only a store's client reaches it."""
    if path.startswith("file:"):
        return urlparse(path).path
    return None if "://" in path else path


class Growing:
    """A file that grows by arrays and gets its final name, whole, when it is closed; so a second
    attempt does no harm, and an attempt that is lost leaves nothing under that name."""

    def __init__(self, path: str):
        own = f"{path}.{uuid.uuid4().hex}"
        self.mounted = local_path(path)
        if self.mounted is None:
            from pyarrow import fs

            self.store, self.final = fs.FileSystem.from_uri(path)
            _, self.own = fs.FileSystem.from_uri(own)
            self.out = self.store.open_output_stream(self.own)
        else:
            os.makedirs(os.path.dirname(self.mounted), exist_ok=True)
            self.own = local_path(own)
            self.out = open(self.own, "wb")

    def add(self, data: np.ndarray) -> None:
        """Append the numbers of an array."""
        self.out.write(np.ascontiguousarray(data).data)

    def close(self) -> None:
        """Give the file its final name."""
        self.out.close()
        if self.mounted is None:
            self.store.move(self.own, self.final)
        else:
            os.replace(self.own, self.mounted)


def mapped(path: str, dtype: str) -> np.ndarray:
    """The file's numbers, memory-mapped where the folder is mounted."""
    mounted = local_path(path)
    if mounted is None:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        with store.open_input_file(inner) as source:
            return np.frombuffer(source.read(), dtype=dtype)
    if not os.path.getsize(mounted):
        return np.empty(0, dtype=dtype)
    return np.memmap(mounted, dtype=dtype, mode="r")
