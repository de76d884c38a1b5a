"""Whole files written by executors into the shared folder, each published by one rename."""

from __future__ import annotations

import uuid

from pyarrow import fs


def put(uri: str, data: bytes) -> None:
    """Writes data at uri.  A retried or speculative task replaces the file by the same bytes."""
    store, path = fs.FileSystem.from_uri(uri)
    folder, _, name = path.rpartition("/")
    store.create_dir(folder, recursive=True)
    hidden = f"{folder}/_{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(hidden) as out:
        out.write(data)
    if store.type_name not in ("local", "subtree") and store.get_file_info(path).type != fs.FileType.NotFound:
        store.delete_file(path)
    store.move(hidden, path)
