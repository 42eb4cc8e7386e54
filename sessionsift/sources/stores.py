"""Files of the shared stores, by URI."""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from urllib.parse import quote


def store_of(path: str):
    """File system and path of a URI or a local path (Hadoop writes ``file:/x``)."""
    from pyarrow import fs
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        path = "file://" + quote(posixpath.abspath(path))
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def read_json(path: str) -> dict | None:
    """The object in a file, or None if there is no such file."""
    store, at = store_of(path)
    try:
        with store.open_input_stream(at) as f:
            return json.loads(f.read())
    except FileNotFoundError:
        return None


def write_json(path: str, value: dict) -> None:
    """Write under another name, then move: readers see the whole file or none."""
    store, at = store_of(path)
    store.create_dir(posixpath.dirname(at), recursive=True)
    temp = f"{posixpath.dirname(at)}/.{uuid.uuid4().hex}"
    with store.open_output_stream(temp) as f:
        f.write(json.dumps(value).encode())
    store.move(temp, at)


def names_in(path: str, ending: str) -> list[str]:
    """Sorted names of the files in a folder that end so; none if there is no such folder."""
    from pyarrow import fs
    store, at = store_of(path)
    found = store.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted(i.base_name for i in found if i.is_file and i.base_name.endswith(ending) and not i.base_name.startswith("."))
