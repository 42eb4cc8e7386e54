"""Arrays in the shared folder: written once by a task, memory-mapped by workers.

A folder with a ``file:`` scheme is mapped; any other scheme that pyarrow knows (hdfs, s3, ...) is read into
memory, array by array.
"""

from __future__ import annotations

import io
import os
import uuid
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np


def _local(uri: str) -> str | None:
    p = urlparse(uri)
    return unquote(p.path) if p.scheme in ("", "file") else None


def save_array(uri: str, array: np.ndarray) -> None:
    """Write under another name, then rename: a repeated task leaves one whole file."""
    path, temp = _local(uri), f".{uuid.uuid4().hex}"
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path + temp, "wb") as f:
            np.save(f, array)
        os.replace(path + temp, path)
        return
    from pyarrow import fs
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    out = io.BytesIO()
    np.save(out, array)
    with store.open_output_stream(path + temp) as f:
        f.write(out.getvalue())
    store.move(path + temp, path)


@lru_cache(maxsize=1 << 16)
def load_array(uri: str) -> np.ndarray:
    path = _local(uri)
    if path is not None:
        return np.load(path, mmap_mode="r") if os.path.getsize(path) > 4096 else np.load(path)
    from pyarrow import fs
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        return np.load(io.BytesIO(f.read()))
