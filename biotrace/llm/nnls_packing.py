"""Packing of token pieces into windows by non-negative least squares.

A document's ids (with an end id) are cut at every window's length; what is left over is
its last piece. Shallow combinations of piece lengths that fill a window exactly are
enumerated, and non-negative least squares fits how often each is repeated to the histogram
of lengths. Repeat counts are rounded down, and the remaining pieces are packed greedily,
longest first. The plan depends on the histogram alone (at most one bin per length), so it
is made on the driver; which piece takes which place follows from its rank among the pieces
of its length, which Spark numbers in salted groups.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from biotrace.llm.common import materialize
from biotrace.llm.tokens import ID_BYTES, default_tokenizer, encoder

# Lengths that take part in combinations of three, most frequent first.
TRIPLE_LENGTHS = 64
SWEEPS = 40
# Pieces of one length that are numbered in one group, on average.
GROUP = 500_000
MIN_GROUPS = 32

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _cut(
    batches: Iterator[pa.RecordBatch], window: int, end_id: int, tokenizer: tuple[str, str]
) -> Iterator[pa.RecordBatch]:
    coder = encoder(tokenizer)
    for batch in batches:
        rows: list[tuple] = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = coder.ids(text.as_py())
            ids.append(end_id)
            data, total = memoryview(ids.tobytes()), len(ids)
            for start in range(0, total, window):
                piece = data[start * ID_BYTES : (start + window) * ID_BYTES]
                rows.append((doc_id, start, len(piece) // ID_BYTES, zlib.crc32(piece), total))
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns],
            ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
        )


def combinations(histogram: dict[int, int], window: int) -> list[Counter]:
    """One to three lengths that occur and fill a window exactly."""
    lengths = sorted(histogram)
    found = [Counter([window])] if window in histogram else []
    found += [Counter([a, window - a]) for a in lengths if a <= window - a and window - a in histogram]
    common = sorted(sorted(lengths, key=lambda a: -histogram[a])[:TRIPLE_LENGTHS])
    for i, a in enumerate(common):
        for b in common[i:]:
            if window - a - b in histogram and window - a - b >= b:
                found.append(Counter([a, b, window - a - b]))
    return found


def least_squares(combos: list[Counter], histogram: dict[int, int]) -> list[float]:
    """Repeat counts >= 0 that fit the histogram best, by coordinate descent."""
    left = {length: float(count) for length, count in histogram.items()}
    times = [0.0] * len(combos)
    for _ in range(SWEEPS):
        moved = 0.0
        for j, combo in enumerate(combos):
            gain = sum(m * left[a] for a, m in combo.items()) / sum(m * m for m in combo.values())
            step = max(-times[j], gain)
            if step:
                times[j] += step
                moved = max(moved, abs(step))
                for a, m in combo.items():
                    left[a] -= m * step
        if moved < 0.25:
            break
    return times


def plan(histogram: dict[int, int], window: int) -> list[tuple[list[int], int]]:
    """(lengths in a window, repeats) that place every piece of the histogram once."""
    left = dict(histogram)
    combos = combinations(histogram, window)
    out = []
    for combo, times in zip(combos, least_squares(combos, histogram), strict=True):
        repeats = min([int(times), *(left[a] // m for a, m in combo.items())])
        if repeats:
            out.append((sorted(combo.elements(), reverse=True), repeats))
            for a, m in combo.items():
                left[a] -= m * repeats
    open_lengths = sorted(a for a, n in left.items() if n)
    while open_lengths:
        chosen: Counter = Counter()
        room = window
        while True:
            at = bisect.bisect_right(open_lengths, room)
            while at and left[open_lengths[at - 1]] <= chosen[open_lengths[at - 1]]:
                at -= 1
            if not at:
                break
            chosen[open_lengths[at - 1]] += 1
            room -= open_lengths[at - 1]
        repeats = min(left[a] // m for a, m in chosen.items())
        out.append((sorted(chosen.elements(), reverse=True), repeats))
        for a, m in chosen.items():
            left[a] -= m * repeats
        open_lengths = [a for a in open_lengths if left[a]]
    return out


def places(windows: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """Runs of ranks of one length: the first rank, its sequence, and the offset there."""
    taken: Counter = Counter()
    rows, base = [], 0
    for lengths, repeats in windows:
        offset = 0
        for length in lengths:
            rows.append((length, taken[length], base, offset))
            taken[length] += repeats
            offset += length
        base += repeats
    rows.sort()
    length, first, sequence, offset = np.array(rows, np.int64).reshape(-1, 4).T
    return {"key": _key(length, first), "sequence": sequence, "offset": offset}


def _key(length: np.ndarray, rank: np.ndarray) -> np.ndarray:
    return (length << np.int64(45)) | rank


def _place(batches: Iterator[pa.RecordBatch], table: dict) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
        key = _key(length, rank)
        at = np.searchsorted(table["key"], key, "right") - 1
        kept = [c for c in batch.schema.names if c != "rank"]
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(c) for c in kept],
                pa.array(table["sequence"][at] + key - table["key"][at]),
                pa.array(table["offset"][at]),
            ],
            [*kept, "sequence_id", "offset"],
        )


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 2048,
    end_id: int = 1,
    tokenizer: tuple[str, str] | None = None,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts give one piece that holds the end id. Every id lies in exactly one
    piece and pieces of a sequence follow each other without gaps from 0. Rows repeated
    under one id are packed each on its own; a null id stays null. An empty table gives an
    empty result. Other columns are not read.
    """
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )
    cut = partial(_cut, window=window, end_id=end_id, tokenizer=tokenizer or default_tokenizer())
    pieces = materialize(texts.mapInArrow(cut, _PIECES), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    groups = max(MIN_GROUPS, max(histogram.values(), default=0) // GROUP)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(groups)))
    by_group = Window.partitionBy("length", "salt")
    local = salted.withColumn(
        "local", F.row_number().over(by_group.orderBy("doc_id", "start", "doc_tokens", "ids_crc32"))
    )
    before = (
        salted.groupBy("length", "salt")
        .count()
        .withColumn(
            "before",
            F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count"),
        )
        .select("length", "salt", "before")
    )
    ranked = local.join(before, ["length", "salt"]).select(
        *pieces.columns, (F.col("local") - 1 + F.col("before")).cast("long").alias("rank")
    )
    table = places(plan(histogram, window))
    return ranked.mapInArrow(
        partial(_place, table=table), f"{_PIECES}, sequence_id long, offset long"
    )
