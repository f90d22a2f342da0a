"""Anchors: positions that a text's own bytes choose.

Of every GRAMS consecutive GRAM-byte strings the one with the smallest hash is an anchor
(all of equals). Any string of LENGTH bytes holds GRAMS of them, so equal strings of that
length have equal anchors at equal places, whatever surrounds them.
"""

from __future__ import annotations

import numpy as np

from biotrace.llm.shingles import _BYTE, _powers, mix

LENGTH = 50
GRAM = 26
GRAMS = LENGTH - GRAM + 1


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` bytes from every position; the last size - 1 have none."""
    n = len(data)
    if n < size:
        return np.zeros(0, np.uint64)
    up, down = _powers(n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    grams = sums[size:] - sums[: n - size + 1]
    grams *= down[: n - size + 1]
    return mix(grams)


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over every `width` consecutive values."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = pick(out[: len(out) - step], out[step:])
        done += step
    return out


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors of all documents in a buffer, and their hashes."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(data) < LENGTH:
        return none
    grams = gram_hashes(data, GRAM)
    least = _sliding(grams, GRAMS, np.minimum)
    # Windows that run over the end of a document choose nothing.
    for end in offsets[1:].tolist():
        least[max(0, end - LENGTH + 1) : end] = 0
    padded = np.zeros(len(grams) + GRAMS - 1, np.uint64)
    padded[GRAMS - 1 : GRAMS - 1 + len(least)] = least
    chosen = _sliding(padded, GRAMS, np.maximum)
    at = np.flatnonzero(chosen == grams)
    at = at[grams[at] > 0]
    return at, grams[at]
