"""Columns of texts in pieces of bounded size: several short texts at once, or parts of a long one."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .textops import Block

#: Bytes of a piece; a longer stretch without a place to cut stays whole.
PIECE = 1 << 20


class Spans(Block):
    """Given spans of some bytes, hashed like the words of a block."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        self.data, self.starts, self.ends = data, starts, ends


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row begins; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offs, buf = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    return np.frombuffer(buf, dtype=np.uint8) if buf is not None and buf.size else np.zeros(0, dtype=np.uint8), offsets


def pieces(column: pa.Array, cut: re.Pattern[bytes], target: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
    """(from, to, bytes, offsets, last): the rows from..to of a column of texts, about target bytes at once.

    A longer text comes by itself in several pieces, each but the first beginning where cut matches; last
    tells its last one.  Whole texts always have last.
    """
    data, offsets = raw(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        if offsets[i + 1] - offsets[i] > target:
            at, end = int(offsets[i]), int(offsets[i + 1])
            text = memoryview(data[at:end])
            at, end = 0, end - at
            while at < end:
                found = cut.search(text, at + target) if at + target < end else None
                stop = found.start() if found else end
                yield i, i + 1, np.frombuffer(text[at:stop], dtype=np.uint8), np.array([0, stop - at]), stop == end
                at = stop
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + target, side="right")) - 1)
        long = np.flatnonzero(np.diff(offsets[i : j + 1]) > target)
        j = i + int(long[0]) if len(long) else j
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], True
        i = j


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each span, one span after another."""
    ends = np.cumsum(size, dtype=np.int64)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
