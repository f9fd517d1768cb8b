"""Files by tasks: each row of a table written as a file of its own."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address, and its path there."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), os.path.abspath(uri))


def write_files(rows: DataFrame, root: str) -> int:
    """Write each of rows (path, content) to root/path, and return how many there were; rows without content give no file.

    A task writes the files of its rows, each under another name that it then moves, so a file is whole or not there, and a task that is run again
    writes the same files again.  No file passes through the driver or waits for the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = located(root)
        made: set[str] = set()
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                target = f"{top}/{path.as_py()}"
                folder = os.path.dirname(target)
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                temporary = f"{folder}/.{uuid.uuid4().hex}"
                with system.open_output_stream(temporary, compression=None) as out:
                    out.write(content.as_buffer())
                system.move(temporary, target)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["files"])

    whole = rows.where("content is not null").select(F.col("path").cast("string").alias("path"), F.col("content").cast("binary").alias("content"))
    return whole.mapInArrow(run, "files long").agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]
