"""Words of texts as arrays: bounds, hashes and hashes of word windows, for a batch of texts at once.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return.
Hashes are 64-bit polynomials by prefix sums, so the cost is a few passes over the bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD1342543DE82EF95
PIECE = 1 << 18
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    table = _tables.get(base)
    if table is None or len(table) < n:
        table = np.full(max(n, PIECE + 1024), base, dtype=np.uint64)
        table[0] = 1
        np.cumprod(table, out=table)
        if n <= 16 * PIECE:
            _tables[base] = table
    return table[:n]


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed one-to-one scrambling of 64-bit values."""
    x = np.asarray(x, dtype=np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_kept: list[Callable[[], None]] = []


def keeper(forget: Callable[[], None]) -> None:
    """``forget`` drops what an operator keeps in a Python worker from one task to the next."""
    _kept.append(forget)


def give_back() -> None:
    """Memory that this Python worker no longer uses goes back to the system, with what operators before have kept here: an
    idle worker of an executor keeps little, and an executor has as many as its tasks ever used at once."""
    for forget in _kept:
        forget()
    trim()


def trim() -> None:
    """Free memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each, one row at least.

    Memory that the last slice no longer needs goes back to the system; after the last batch all that is free does.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(size, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, before + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end
            pa.default_memory_pool().release_unused()
    batch = None
    trim()


class Words:
    """The words of a list of texts (bytes), in order."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        size = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.doc_end = np.cumsum(size)
        self.doc_start = self.doc_end - size
        white = np.ones(len(self.data) + 1, dtype=np.int8)
        white[1:] = WHITE[self.data]
        edge = np.diff(white)
        self.start = np.flatnonzero(edge == -1)
        self.end = np.flatnonzero(edge == 1)
        if len(self.end) < len(self.start):
            self.end = np.append(self.end, len(self.data))
        #: first word of each text, and the number of words after the last
        self.first = np.searchsorted(self.start, np.append(self.doc_start, len(self.data)))
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.count)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        out = np.empty(len(self.start), dtype=np.uint64)
        at = 0
        while at < len(self.start):
            low = self.start[at]
            to = max(at + 1, int(np.searchsorted(self.end, low + PIECE, side="right")))
            n = int(self.end[to - 1] - low)
            total = np.zeros(n + 1, dtype=np.uint64)
            part = self.data[low : low + n].astype(np.uint64)
            part += np.uint64(1)
            part *= _powers(BYTE_BASE, n)
            np.cumsum(part, out=total[1:])
            s, e = self.start[at:to] - low, self.end[at:to] - low
            out[at:to] = (total[e] - total[s]) * _powers(_inverse(BYTE_BASE), n)[s]
            at = to
        return mix(out + (self.end - self.start).astype(np.uint64))

    def windows(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of the windows of ``k`` words inside one text, and a hash of each window."""
        n = len(hashes)
        if n < k:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        at = np.flatnonzero(self.doc[: n - k + 1] == self.doc[k - 1 :])
        return at, rolling(hashes, k)[at]


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` consecutive values."""
    n = len(values)
    if n < k:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * _powers(WORD_BASE, n), out=total[1:])
    return mix((total[k:] - total[:-k]) * _powers(_inverse(WORD_BASE), n)[: n - k + 1])


def covered(at: np.ndarray, k: int, n: int) -> np.ndarray:
    """Whether each of ``n`` words lies in a window of ``k`` words that starts at one of ``at``."""
    edge = np.bincount(at, minlength=n + k + 1)[: n + k + 1]
    edge[k:] -= np.bincount(at, minlength=n + 1)[: n + 1]
    return np.cumsum(edge)[:n] > 0


def text_bytes(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8, null as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]
