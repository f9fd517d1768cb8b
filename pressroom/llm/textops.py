"""Vectorised word and shingle hashing over Arrow string columns.

Words are runs of bytes of one class of ASCII characters (every byte of a
non-ASCII character counts as a word byte), so splitting UTF-8 bytes gives the
same words as splitting characters.  All functions work on blocks of whole
documents; memory follows the block, never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RADIX = 0x9E3779B97F4A7C15
_SHINGLE = U64(0xD6E8FEB86659FD93)
_PIECE = 1 << 18


def byte_class(separators: bytes) -> np.ndarray:
    """True for each byte value that belongs to a word."""
    out = np.ones(256, dtype=bool)
    out[list(separators)] = False
    return out


#: Words `[^\x20\x09-\x0D]+`.
SPACED = byte_class(bytes([0x20, *range(0x09, 0x0E)]))
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, for text in lower case.
ALNUM = byte_class(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xA0761D6478BD642F))


class _Powers:
    """Powers of an odd radix and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=U64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << (n - 1).bit_length()
            inverse = pow(_RADIX, -1, 1 << 64)
            for name, base in (("up", _RADIX), ("down", inverse)):
                steps = np.full(size, base, dtype=U64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_powers = _Powers()


class Block:
    """Some whole documents: their bytes, words and word hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word: np.ndarray, lower: bool) -> None:
        self.raw = data
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        inside = word[self.data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        before = np.concatenate(([False], inside[:-1])) if len(data) else inside
        after = np.concatenate((inside[1:], [False])) if len(data) else inside
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        #: Words of document i are bounds[i] to bounds[i + 1].
        self.bounds = np.searchsorted(self.starts, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word; bytes are taken in pieces of about _PIECE, which bounds the tables beside them."""
        out, i = np.empty(len(self.starts), dtype=U64), 0
        while i < len(out):
            base = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, base + _PIECE, side="right")))
            data = self.data[base : self.ends[j - 1]]
            first, last = self.starts[i:j] - base, self.ends[i:j] - base
            up, down = _powers(len(data) + 1)
            total = np.zeros(len(data) + 1, dtype=U64)
            np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
            out[i:j] = mix((total[last] - total[first]) * down[first] + (last - first).astype(U64) * U64(_RADIX))
            i = j
        return out

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all k-word windows within a document, and bounds by document."""
        n = np.maximum(self.counts - k + 1, 0)
        bounds = np.concatenate(([0], np.cumsum(n)))
        first = np.repeat(self.bounds[:-1] - bounds[:-1], n) + np.arange(bounds[-1])
        return first, bounds

    def word_bytes(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def combine(h: np.ndarray, first: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the k word hashes from each first word on."""
    out = np.full(len(first), (seed * _RADIX + k) & 0xFFFFFFFFFFFFFFFF, dtype=U64)
    for j in range(k):
        out = out * _SHINGLE + h[first + j]
    return mix(out)


def blocks(column: pa.Array, word: np.ndarray, lower: bool = False, target: int = 1 << 21) -> Iterator[tuple[int, int, Block]]:
    """(from, to, Block) over the rows of a string column, about target bytes each; null is empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if len(column) == 0:
        return
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offs, buf = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None and buf.size else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + target, side="right")) - 1)
        j = min(j, len(column))
        yield i, j, Block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], word, lower)
        i = j
