"""Files in the shared folder, written and read by tasks through Arrow's file systems."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyarrow import fs


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI, or of a local path; file:///x and file:/x are the same."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), os.path.abspath(uri)
    return fs.FileSystem.from_uri(uri)


@contextmanager
def replacing(uri: str) -> Iterator[Callable[[bytes], int]]:
    """Write a file under another name and move it to uri at the end, so that a repeated task leaves one whole file."""
    system, path = locate(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with system.open_output_stream(part, compression=None) as out:
            yield out.write
        system.move(part, path)
    except BaseException:
        if system.get_file_info(part).type != fs.FileType.NotFound:
            system.delete_file(part)
        raise


def read_at(uri: str):
    """A seekable file."""
    system, path = locate(uri)
    return system.open_input_file(path)


def read_all(uri: str) -> bytes:
    with read_at(uri) as f:
        return f.read()
