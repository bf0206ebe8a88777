"""Vectorised words and word hashes over batches of UTF-8 texts (numpy only, runs in Python workers)."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; the arrays beside it take about 40 times as much.
SLICE_BYTES = 1 << 20

#: Bytes of words `[^\x20\x09-\x0D]+`.
SPACED = np.ones(256, bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`: digits, lower-case letters and all that is not ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_BASE, _MIX, _LEN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_pow = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """At least n powers of the hash's base, modulo 2**64."""
    global _pow
    if len(_pow) < n:
        grown = np.full(max(n, 2 * len(_pow), 256), _BASE, np.uint64)
        grown[0] = 1
        _pow = np.cumprod(grown, dtype=np.uint64)
    return _pow


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit over the output."""
    h = h ^ (h >> np.uint64(30))
    h = h * _MIX
    h = h ^ (h >> np.uint64(27))
    h = h * _LEN
    return h ^ (h >> np.uint64(31))


@lru_cache(1)
def _trim() -> Callable:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, with the memory that a batch took given back to the system after it: Python workers are kept for later tasks, and share their executor's memory."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            for out in run(batches):
                yield out
                del out
                pa.default_memory_pool().release_unused()
                _trim()(0)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return tidied


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(sizes: list[int], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes; a longer row makes a range of its own."""
    at = total = 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


class Words:
    """The words of some texts: `hash`, `start` and `end` in `data` by word; `first[i]` is the first word of text i, and `first[-1]` the number of words."""

    def __init__(self, texts: list[bytes], kind: np.ndarray = SPACED, lower: bool = True):
        joined = b" ".join(texts)
        self.data = joined.lower() if lower else joined
        raw = np.frombuffer(self.data, np.uint8)
        inside = kind[raw]
        step = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        self.start, self.end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        begins = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
        self.first = np.searchsorted(self.start, begins)
        size = self.end - self.start
        if not len(size):
            self.hash = np.zeros(0, np.uint64)
            return
        offset = np.cumsum(size) - size
        within = np.arange(int(offset[-1] + size[-1])) - np.repeat(offset, size)
        terms = (raw[inside].astype(np.uint64) + np.uint64(1)) * powers(int(size.max()))[within]
        self.hash = mix(np.add.reduceat(terms, offset) + size.astype(np.uint64) * _LEN)

    def __len__(self) -> int:
        return len(self.start)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]]

    def words(self, a: int, b: int) -> list[bytes]:
        data = self.data
        return [data[x:y] for x, y in zip(self.start[a:b].tolist(), self.end[a:b].tolist(), strict=True)]
