"""Centroid clustering over a vector approximation file.

Every component of an integer vector is kept as the number of a cell of a few bits. Cell
marks come from a bounded sample, so that cells hold about equally many values; the outer
cells reach to the smallest and largest value of all vectors. The file of approximations
holds a packed row of cells per vector, beside the full vectors.

A round of the clustering looks up, per component and cell, the least and largest squared
difference to every centroid. Their sums are an interval of the distance. A vector whose
intervals leave one centroid is assigned from the approximation alone; only for the others
is the full vector fetched. From the second round on, sums change by the vectors that move:
cells tell with the last and the new centroids which vectors certainly stay, and those are
not fetched either. No state is kept per vector, so a lost task repeats itself exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biotrace.llm.common import materialize
from biotrace.llm.vectors import packed, scaled, unpacked

# Bits of a cell, and vectors that the cell marks are fitted on.
BITS = 6
SAMPLE = 8_192
# Components times the scale must stay within this, so that distances fit in 64 bits.
MOST = 2**26
# Vectors looked up at a time.
BATCH = 4_096

_NONE = -1


def cell_marks(sample: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
    """Smallest value of every cell, per component; about equally many values in each."""
    marks = []
    for d in range(sample.shape[1]):
        first, last, cells = int(low[d]), int(high[d]), 2**BITS
        if last - first < cells:
            marks.append(np.arange(first, last + 1))
            continue
        quantiles = np.quantile(sample[:, d], np.linspace(0, 1, cells), method="lower")
        chosen = np.unique(np.append(np.clip(quantiles, first, last), first)).astype(np.int64)
        even = np.linspace(first, last, cells).astype(np.int64)
        spare = np.setdiff1d(even, chosen)[: max(0, cells - len(chosen))]
        marks.append(np.union1d(chosen, spare)[:cells])
    return marks


def encode(matrix: np.ndarray, marks: list[np.ndarray]) -> np.ndarray:
    """Packed cell numbers of every vector."""
    cells = np.stack(
        [np.searchsorted(m, matrix[:, d], "right") - 1 for d, m in enumerate(marks)], axis=1
    ).astype(np.uint8)
    bits = (cells[:, :, None] >> np.arange(BITS, dtype=np.uint8)) & 1
    return np.packbits(bits.reshape(len(cells), -1), axis=1)


def decode(rows: np.ndarray, size: int) -> np.ndarray:
    bits = np.unpackbits(rows, axis=1, count=size * BITS).reshape(len(rows), size, BITS)
    return (bits << np.arange(BITS, dtype=np.uint8)).sum(axis=2, dtype=np.int64)


class Lookup:
    """Least and largest squared difference of a cell to every centroid, per component."""

    def __init__(self, marks: list[np.ndarray], high: np.ndarray, centroids: np.ndarray):
        self.centroids = centroids
        self.least, self.largest = [], []
        for d, first in enumerate(marks):
            last = np.append(first[1:] - 1, high[d])
            to_first = first[:, None] - centroids[None, :, d]
            to_last = last[:, None] - centroids[None, :, d]
            inside = (to_first <= 0) & (to_last >= 0)
            ends = np.minimum(to_first**2, to_last**2)
            self.least.append(np.where(inside, 0, ends))
            self.largest.append(np.maximum(to_first**2, to_last**2))

    def nearest(self, cells: np.ndarray) -> np.ndarray:
        """The only centroid that the intervals leave, or -1."""
        least = np.zeros((len(cells), len(self.centroids)), np.int64)
        largest = np.zeros_like(least)
        for d in range(cells.shape[1]):
            least += self.least[d][cells[:, d]]
            largest += self.largest[d][cells[:, d]]
        left = least <= largest.min(axis=1, keepdims=True)
        return np.where(left.sum(axis=1) == 1, left.argmax(axis=1), _NONE)

    def fetched(self, full: np.ndarray) -> np.ndarray:
        """The nearest centroid of full vectors; the smaller number of equally near ones."""
        cross = full @ self.centroids.T
        return ((self.centroids**2).sum(axis=1)[None, :] - 2 * cross).argmin(axis=1)

    def assigned(self, cells: np.ndarray, full: np.ndarray) -> np.ndarray:
        near = self.nearest(cells)
        open_ = near == _NONE
        near[open_] = self.fetched(full[open_])
        return near


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH):
            yield batch.slice(start, BATCH)


def _cells(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return decode(unpacked(batch.column("cells"), np.uint8, -(-size * BITS // 8)), size)


def _full(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return unpacked(batch.column("full"), np.int32, size).astype(np.int64)


def _whole(batches: Iterator[pa.RecordBatch], size: int, scale: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        places, matrix = scaled(batch.column(1), size, scale, MOST)
        ids = batch.column(0).take(pa.array(places))
        full = packed(matrix.astype(np.int32))
        yield pa.RecordBatch.from_arrays([ids, full], ["id", "full"])


def _approximate(
    batches: Iterator[pa.RecordBatch], size: int, marks: list[np.ndarray]
) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches):
        cells = packed(encode(_full(batch, size), marks))
        yield pa.RecordBatch.from_arrays([*batch.columns, cells], [*batch.schema.names, "cells"])


def _range(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Smallest and largest value of every component."""
    low, high = np.full(size, MOST), np.full(size, -MOST)
    for batch in _parts(batches):
        full = _full(batch, size)
        low, high = np.minimum(low, full.min(axis=0)), np.maximum(high, full.max(axis=0))
    d = np.arange(size, dtype=np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(low), pa.array(high)], ["d", "low", "high"])


def _sums(
    into: dict[int, list], clusters: np.ndarray, full: np.ndarray, sign: int
) -> None:
    for c in np.unique(clusters).tolist():
        own = full[clusters == c]
        held = into.setdefault(c, [0, np.zeros(full.shape[1], np.int64)])
        held[0] += sign * len(own)
        held[1] += sign * own.sum(axis=0)


def _as_rows(sums: dict[int, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(list(sums), pa.int32()),
            pa.array([n for n, _ in sums.values()], pa.int64()),
            pa.array([s.tolist() for _, s in sums.values()], pa.list_(pa.int64())),
        ],
        ["cluster", "n", "sums"],
    )


def _first_sums(batches: Iterator[pa.RecordBatch], size: int, at: Lookup) -> Iterator[pa.RecordBatch]:
    sums: dict[int, list] = {}
    for batch in _parts(batches):
        full = _full(batch, size)
        _sums(sums, at.assigned(_cells(batch, size), full), full, 1)
    yield _as_rows(sums)


def _open(batches: Iterator[pa.RecordBatch], size: int, old: Lookup, new: Lookup) -> Iterator[pa.RecordBatch]:
    """Rows whose cells do not show that the vector stays where it was."""
    for batch in _parts(batches):
        cells = _cells(batch, size)
        before, after = old.nearest(cells), new.nearest(cells)
        stays = (before == after) & (before != _NONE)
        yield pa.RecordBatch.from_arrays([batch.column("row").filter(pa.array(~stays))], ["row"])


def _moved(batches: Iterator[pa.RecordBatch], size: int, old: Lookup, new: Lookup) -> Iterator[pa.RecordBatch]:
    """What fetched vectors take from their last cluster and bring to the new one."""
    sums: dict[int, list] = {}
    for batch in _parts(batches):
        full = _full(batch, size)
        before, after = old.fetched(full), new.fetched(full)
        moves = before != after
        _sums(sums, before[moves], full[moves], -1)
        _sums(sums, after[moves], full[moves], 1)
    yield _as_rows(sums)


def _placed(batches: Iterator[pa.RecordBatch], size: int, at: Lookup) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches):
        full = _full(batch, size)
        near = at.assigned(_cells(batch, size), full)
        distance = ((full - at.centroids[near]) ** 2).sum(axis=1)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(near.astype(np.int32)), pa.array(distance)],
            ["id", "cluster", "distance"],
        )


_SUMS = "cluster int, n long, sums array<long>"


def _total(parts: DataFrame, size: int) -> dict[int, tuple[int, list[int]]]:
    """Sums by cluster, added up before the shuffle; one row per centroid comes back."""
    each = [F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(size)]
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *each).collect()
    return {r["cluster"]: (r["n"], [r[f"s{d}"] for d in range(size)]) for r in rows}


def va_file(
    vectors: DataFrame, id_col: str, vector_col: str, size: int, scale: int
) -> tuple[DataFrame, list[np.ndarray], np.ndarray] | None:
    """The written file (row, id, full, cells), the cell marks, and the largest values.

    None where no vector is usable.
    """
    plain = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    )
    whole = partial(_whole, size=size, scale=scale)
    kept = plain.mapInArrow(whole, "id long, full binary")
    kept = materialize(kept.withColumn("row", F.monotonically_increasing_id()), "vectors")
    drawn = kept.orderBy(F.xxhash64("full", "id"), "row").select("full").limit(SAMPLE).collect()
    if not drawn:
        return None
    sample = np.stack([np.frombuffer(r["full"], np.int32) for r in drawn]).astype(np.int64)
    ranges = kept.select("full").mapInArrow(partial(_range, size=size), "d int, low long, high long")
    ends = ranges.groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    ends = sorted(ends.collect(), key=lambda r: r["d"])
    low, high = (np.array([r[c] for r in ends], np.int64) for c in ("low", "high"))
    marks = cell_marks(sample, low, high)
    approximate = partial(_approximate, size=size, marks=marks)
    schema = "row long, id long, full binary, cells binary"
    stored = kept.select("row", "id", "full").mapInArrow(approximate, schema)
    return materialize(stored, "va-file"), marks, high


def cluster_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    *,
    size: int = 64,
    scale: int = 64,
    clusters: int = 16,
    rounds: int = 3,
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector.

    Vectors with exactly `size` components, none null or non-finite, take part as integers
    floor(scale * x); all others are left out. Centroids start as the vectors with the
    smallest sha256 of `1:<id>`; vectors without an id come last there, and repeated ids are
    vectors of their own, ordered by content. Fewer vectors than `clusters` give fewer
    centroids. Equally near centroids: the smaller number. Centroids without vectors stay.
    No usable vector gives an empty result. A component beyond MOST is an error. Only the
    two named columns are read.
    """
    made = va_file(vectors, id_col, vector_col, size, scale)
    if made is None:
        shape = "cast(null as {0}) AS {1}".format
        kinds = ["cluster int", "distance long", "cluster_inertia long", "inertia long", "centroid_sha256 string"]
        return vectors.limit(0).select(
            F.col(id_col).cast("long").alias("id"),
            *[F.expr(shape(*reversed(kind.split()))) for kind in kinds],
        )
    stored, marks, high = made
    key = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    seeds = stored.orderBy(key.asc_nulls_last(), "full", "row").select("full").limit(clusters).collect()
    centroids = np.stack([np.frombuffer(r["full"], np.int32) for r in seeds]).astype(np.int64)
    held: dict[int, tuple[int, list[int]]] = {}
    before: Lookup | None = None
    for _ in range(rounds):
        now = Lookup(marks, high, centroids)
        if before is None:
            sums = partial(_first_sums, size=size, at=now)
            parts = stored.select("cells", "full").mapInArrow(sums, _SUMS)
        else:
            open_ = partial(_open, size=size, old=before, new=now)
            rows = stored.select("row", "cells").mapInArrow(open_, "row long")
            fetched = stored.select("row", "full").join(rows, "row").select("full")
            parts = fetched.mapInArrow(partial(_moved, size=size, old=before, new=now), _SUMS)
        for c, (n, sums) in _total(parts, size).items():
            had, old = held.get(c, (0, [0] * size))
            held[c] = (had + n, [a + b for a, b in zip(old, sums, strict=True)])
        centroids = centroids.copy()
        for c, (n, sums) in held.items():
            if n:
                centroids[c] = [s // n for s in sums]
        before = now
    last = Lookup(marks, high, centroids)
    placed = stored.select("id", "cells", "full").mapInArrow(
        partial(_placed, size=size, at=last), "id long, cluster int, distance long"
    )
    placed = materialize(placed, "clusters")
    # One row per centroid.
    inertia = {
        r["cluster"]: r["inertia"]
        for r in placed.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()
    }
    total = sum(inertia.values())

    def by_cluster(values: dict[int, object], kind: str):
        pairs = [F.lit(x) for c, v in sorted(values.items()) for x in (c, v)]
        return F.create_map(*pairs)[F.col("cluster")].cast(kind)

    digests = {
        c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
        for c in inertia
    }
    return placed.select(
        "id",
        "cluster",
        "distance",
        by_cluster(inertia, "long").alias("cluster_inertia"),
        F.lit(total).cast("long").alias("inertia"),
        by_cluster(digests, "string").alias("centroid_sha256"),
    )
