"""Files that tasks write to and read from the shared store (any pyarrow filesystem URI)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs as pafs


def locate(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


@contextmanager
def writing(uri: str) -> Iterator:
    """A stream to ``uri`` that appears there whole, when it is closed."""
    fs, path = locate(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(part) as out:
        yield out
    fs.move(part, path)


@contextmanager
def reading(uri: str) -> Iterator:
    """A file that can be read at any place."""
    fs, path = locate(uri)
    with fs.open_input_file(path) as f:
        yield f
