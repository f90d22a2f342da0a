"""Words and word shingles of whole texts as 64-bit hashes, many documents at a time.

A word is `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z. The set of a document holds its
distinct runs of five words; with fewer words the whole sequence is the only member;
without words the set is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
# Bytes hashed at a time; a longer document is hashed alone.
SEGMENT = 2_000_000

_RNG = np.random.Generator(np.random.PCG64(20240501))


def _odd(n: int) -> np.ndarray:
    return _RNG.integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)


_BYTE = _odd(256)
_BASE = _odd(1)[0]
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_STEP = _odd(WORDS)
_SHORT = _odd(WORDS)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FOLDED = _BYTE[_LOWER]
_FOLDED[_SPACE] = 0


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits of a 64-bit hash."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values and the offsets of each; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _segments(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + SEGMENT, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, SEGMENT)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and how many words precede each document."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    up, down = _powers(n)
    space = _SPACE[data]
    begins = np.empty(n, bool)
    begins[0] = True
    begins[1:] = space[:-1]
    inner = offsets[:-1]
    begins[inner[inner < n]] = True
    begins &= ~space
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    values = _FOLDED[data]
    values *= up[:n]
    words = mix(np.add.reduceat(values, starts) * down[starts])
    return words, np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of every document, in order."""
    data, offsets = bytes_of(column)
    for first, last in _segments(offsets):
        part = offsets[first : last + 1]
        words, at = word_hashes(data[part[0] : part[-1]], part - part[0])
        runs = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
        for j in range(WORDS):
            runs += words[j : j + len(runs)] * _STEP[j]
        runs = mix(runs)
        for low, high in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            count = high - low
            if count >= WORDS:
                yield np.unique(runs[low : high - WORDS + 1])
            elif count:
                one = (words[low:high] * _STEP[:count]).sum(dtype=np.uint64, keepdims=True)
                yield mix(one + _SHORT[count])
            else:
                yield np.zeros(0, np.uint64)
