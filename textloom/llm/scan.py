"""Vectorised word scanning over Arrow string columns.

A column's UTF-8 buffer is scanned as one numpy array: separators come from a
256-entry table, word bounds from flag changes, word hashes from prefix sums of
a polynomial modulo 2**64. Cost is a few nanoseconds a byte and there is no
Python object per word. Work is done in chunks of whole documents, so memory
follows ``CHUNK_BYTES`` (or the longest single text), not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that are scanned at once; a longer text is one chunk by itself.
CHUNK_BYTES = 1 << 20

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _table(seps: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(seps)] = True
    return table


#: Space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = _table(bytes([0x20, *range(0x09, 0x0E)]))
#: Everything but 0-9, a-z and bytes of non-ASCII characters (after A-Z are lower-cased).
NON_ALNUM = _table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES)
        for k, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, U64)
            table[0] = 1
            np.multiply.accumulate(table, out=table)
            _powers[k:] = [table]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


class Words(NamedTuple):
    """Words of a chunk of documents, in document order."""

    rows: slice  # the documents' places in the batch
    buf: np.ndarray  # the (lower-cased) bytes of the chunk
    base: int  # place of the chunk's first byte in the column's buffer
    start: np.ndarray  # first byte of each word, within buf
    end: np.ndarray
    first: np.ndarray  # first word of each document; one more entry than documents
    hash: np.ndarray | None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        """The document (within the chunk) of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def text(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, limit: int = 0) -> Iterator[slice]:
    """Runs of whole documents of about ``limit`` bytes."""
    n, at, limit = len(offsets) - 1, 0, limit or CHUNK_BYTES
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), n)
        yield slice(at, to)
        at = to


def scan(column: pa.Array, seps: np.ndarray, lower: bool = False, hashes: bool = True, limit: int = 0) -> Iterator[Words]:
    """The words of a string column, chunk by chunk."""
    data, offsets = text_buffer(column)
    for rows in chunks(offsets, limit):
        lo, hi = int(offsets[rows.start]), int(offsets[rows.stop])
        buf = data[lo:hi]
        if lower:
            buf = _LOWER[buf]
        bounds = offsets[rows.start : rows.stop + 1] - lo
        inside = ~seps[buf]
        before = np.empty_like(inside)
        before[1:], before[:1] = inside[:-1], False
        after = np.empty_like(inside)
        after[:-1], after[-1:] = inside[1:], False
        cuts = bounds[bounds < hi - lo]
        before[cuts] = False
        after[cuts[cuts > 0] - 1] = False
        start = np.flatnonzero(inside & ~before)
        end = np.flatnonzero(inside & ~after) + 1
        first = np.searchsorted(start, bounds)
        h = None
        if hashes:
            up, down = _power_tables(hi - lo + 1)
            sums = np.zeros(hi - lo + 1, U64)
            digits = buf.astype(U64)
            digits += U64(1)
            digits *= up[: hi - lo]
            np.cumsum(digits, out=sums[1:])
            h = mix((sums[end] - sums[start]) * down[start])
        yield Words(rows, buf, lo, start, end, first, h)


def tidy(run):
    """A batch function that gives freed memory back to the system when its task ends.

    Python workers live on between tasks and stages; what one leaves allocated would
    count against the next.
    """

    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return tidied


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive words (document bounds are the caller's)."""
    if len(h) < k:
        return np.zeros(0, U64)
    n = len(h) - k + 1
    out = np.zeros(n, U64)
    for j in range(k):
        out *= U64(0xD6E8FEB86659FD93)
        out += h[j : j + n]
    return mix(out)


def hash_bytes(words: list[bytes]) -> np.ndarray:
    """The same hashes as :func:`scan` gives, for single words."""
    out = np.zeros(len(words), U64)
    mask = (1 << 64) - 1
    for i, w in enumerate(words):
        total, p = 0, 1
        for b in w:
            total, p = (total + (b + 1) * p) & mask, (p * _BASE) & mask
        out[i] = total
    return mix(out)
