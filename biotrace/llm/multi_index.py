"""Near-duplicate vectors by an inverted multi-index.

Unit vectors are cut into two halves, and each half gets its own codebook (k-means on a
bounded sample). A vector lies in the cell of the two nearest centroids; the cells form a
product grid. A query visits cells in the order of a lower bound of their distance
(multi-sequence traversal over the two sorted codebooks) until the bound that gives the
target recall for the hardest pairs: the sample is turned by exactly the angle of the
least similarity, in random directions, and the bound must reach the cell of all but a
share of 1 - RECALL of them. More similar pairs lie in nearer cells. Pairs found are
verified by cosine in double precision.

The codebooks grow with the square root of the vectors, so that cells keep their size.
Neighbouring cells of the first half that hold few vectors are bundled: a vector travels
once to each bundle it visits a cell of, and is compared with all of the bundle.

Equal vectors take part once and are counted. A bundle is cut into bounded blocks, and the
visitors of a block are compared with it in bounded batches.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biotrace.llm.common import grouped, materialize
from biotrace.llm.components import components

# Least and most centroids per half, vectors a cell should hold, vectors the codebooks are
# fitted on, and rounds of k-means.
CENTROIDS = 8, 512
CELL = 64
SAMPLE = 8_192
ROUNDS = 12
# Vectors of a bundle in one block, and visitors compared with it at a time.
BLOCK = 2_048
BATCH = 2_048
# Share of pairs at the least similarity that a query finds, and turns of a sampled vector.
RECALL = 0.999
TURNS = 8


def kmeans(points: np.ndarray, k: int) -> np.ndarray:
    """Centroids of a bounded sample; fewer where it has fewer distinct points."""
    points = np.unique(points, axis=0)
    random = np.random.Generator(np.random.PCG64(6))
    centres = points[random.permutation(len(points))[:k]]
    for _ in range(ROUNDS):
        near = nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        sizes = np.bincount(near, minlength=len(centres))
        filled = sizes > 0
        centres[filled] = sums[filled] / sizes[filled, None]
    return centres


def _squares(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    both = (points**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1)[None, :]
    return np.maximum(both - 2 * points @ centres.T, 0)


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return _squares(points, centres).argmin(axis=1)


def bounds(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distance from each point to each centroid's region, from below."""
    squares = _squares(points, centres)
    own = squares.argmin(axis=1)
    gaps = np.sqrt(_squares(centres, centres))[own]
    beyond = squares - squares[np.arange(len(points)), own][:, None]
    return np.divide(beyond, 2 * gaps, out=np.zeros_like(beyond), where=gaps > 0) ** 2


def traverse(first: np.ndarray, second: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Cells (i, j) by rising first[i] + second[j], as long as it is within the limit."""
    rows, columns = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    queue, out, reached = [(float(first[rows[0]] + second[columns[0]]), 0, 0)], [], {(0, 0)}
    while queue:
        bound, a, b = heapq.heappop(queue)
        if bound > limit:
            break
        out.append((int(rows[a]), int(columns[b])))
        for step in ((a + 1, b), (a, b + 1)):
            if step[0] < len(rows) and step[1] < len(columns) and step not in reached:
                reached.add(step)
                total = float(first[rows[step[0]]] + second[columns[step[1]]])
                heapq.heappush(queue, (total, *step))
    return out


def reach(points: np.ndarray, books: tuple[np.ndarray, np.ndarray], least: float) -> float:
    """The bound up to which a query visits cells, for the target recall."""
    random = np.random.Generator(np.random.PCG64(60))
    points = np.repeat(points[: max(1, SAMPLE // 4)], TURNS, axis=0)
    turn = random.normal(size=points.shape)
    turn -= (turn * points).sum(axis=1, keepdims=True) * points
    size = np.sqrt((turn**2).sum(axis=1, keepdims=True))
    turned = least * points + np.sqrt(max(0.0, 1 - least**2)) * turn / np.where(size > 0, size, 1)
    half, needed = books[0].shape[1], np.zeros(len(points))
    for book, side in zip(books, (slice(0, half), slice(half, None)), strict=True):
        cells = nearest(turned[:, side], book)
        needed += bounds(points[:, side], book)[np.arange(len(points)), cells]
    return float(np.quantile(needed, RECALL, method="higher"))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.stack([np.frombuffer(v, np.float64) for v in column.to_pylist()])


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors as bytes of doubles; null for vectors that link with nothing."""
    for batch in batches:
        out = []
        for value in batch.column(1).to_pylist():
            vector = None
            if value and None not in value:
                # A single component gets a second one, so that there are two halves.
                raw = np.array(value if len(value) > 1 else [*value, 0.0], np.float64)
                # Scaled first, so that squares of very large or small values stay finite.
                top = np.abs(raw).max()
                if np.isfinite(raw).all() and top > 0:
                    raw = raw / top
                    vector = (raw / np.sqrt((raw * raw).sum())).tobytes()
            out.append(vector)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "unit"])


def _homes(batches: Iterator[pa.RecordBatch], books: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The cell of every vector."""
    half = books[0].shape[1]
    for batch in batches:
        cells = np.zeros(0, np.int64)
        if batch.num_rows:
            points = _matrix(batch.column(0))
            cells = nearest(points[:, :half], books[0]) * len(books[1]) + nearest(points[:, half:], books[1])
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int64))], ["cell"])


def bundles_of(counts: np.ndarray) -> np.ndarray:
    """Bundle of every cell: runs of cells of one row of the grid with up to BLOCK vectors."""
    bundles, number = np.zeros(counts.shape, np.int32), 0
    for row, held in enumerate(counts):
        filled = 0
        for column, count in enumerate(held.tolist()):
            if column and filled + count > BLOCK:
                number, filled = number + 1, 0
            bundles[row, column] = number
            filled += count
        number += 1
    return bundles


def _visit(
    batches: Iterator[pa.RecordBatch],
    books: tuple[np.ndarray, np.ndarray],
    limit: float,
    bundles: np.ndarray,
) -> Iterator[pa.RecordBatch]:
    """A row per vector and bundle with a visited cell; `home` marks the vector's own."""
    half = books[0].shape[1]
    for batch in batches:
        if not batch.num_rows:
            continue
        points = _matrix(batch.column(1))
        sides = [points[:, :half], points[:, half:]]
        low = [bounds(p, c) for p, c in zip(sides, books, strict=True)]
        own = [nearest(p, c) for p, c in zip(sides, books, strict=True)]
        take, visited, home = [], [], []
        for i in range(len(points)):
            at = bundles[own[0][i], own[1][i]]
            cells = traverse(low[0][i], low[1][i], limit)
            found = {at, *(bundles[a, b] for a, b in cells)}
            take += [i] * len(found)
            visited += found
            home += [bundle == at for bundle in found]
        rows = pa.array(take, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(rows),
                pa.array(np.array(visited, np.int64)),
                pa.array(np.array(home, bool)),
            ],
            ["rep", "cell", "home"],
        )


def _compare(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Per visitor of a block: how many vectors it links to, and one it is connected with.

    Vectors of the block that are linked follow with no links of their own, so that the
    rows connect whatever the links shown here connect.
    """
    for _, table in _blocks(batches):
        home = table.column("side").to_numpy() == 0
        units = _matrix(table.column("unit"))
        reps, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
        ids, owned, weights = reps[home], units[home], copies[home].astype(np.float64)
        order = np.argsort(ids, kind="stable")
        ids, owned, weights = ids[order], owned[order], weights[order]
        visitors = np.flatnonzero(~home)
        for start in range(0, len(visitors), BATCH):
            part = visitors[start : start + BATCH]
            if not len(owned):
                continue
            linked = units[part] @ owned.T >= least
            linked &= reps[part][:, None] != ids[None, :]
            rows, columns = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
            by_row, by_column = _labels(linked[np.ix_(rows, columns)], ids[columns])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([reps[part][rows], ids[columns]])),
                    pa.array(
                        np.concatenate(
                            [(linked[rows] @ weights).astype(np.int64), np.zeros(len(columns), np.int64)]
                        )
                    ),
                    pa.array(np.concatenate([by_row, by_column])),
                ],
                ["rep", "links", "first"],
            )


def _labels(linked: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest column id that each row and each column reaches over the links shown."""
    by_column = ids.copy()
    by_row = np.zeros(len(linked), ids.dtype)
    most = np.iinfo(ids.dtype).max
    while linked.size:
        by_row = np.where(linked, by_column[None, :], most).min(axis=1)
        lower = np.minimum(by_column, np.where(linked, by_row[:, None], most).min(axis=0))
        if (lower == by_column).all():
            break
        by_column = lower
    return by_row, by_column


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    return grouped(batches, ["cell", "block", "lot"])


def _sample(reps: DataFrame) -> np.ndarray:
    """At most SAMPLE vectors, taken by a hash of the vector."""
    rows = reps.orderBy(F.xxhash64("unit"), "rep").select("unit").limit(SAMPLE).collect()
    return np.stack([np.frombuffer(r["unit"], np.float64) for r in rows])


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95
) -> DataFrame:
    """(id, n_links, component_id, kept) of every vector.

    n_links counts the other vectors with a cosine of at least `least`; component_id is the
    smallest id reachable over links; kept marks the rows that carry it. Null, zero and
    empty vectors and those with null or non-finite components link with nothing, and
    neither do vectors with unlike numbers of components. Rows repeated under one id count
    as vectors of their own. An empty table gives an empty result. A null id stays null and
    takes no part. Only the two named columns are read.
    """
    plain = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    )
    units = materialize(plain.mapInArrow(_unit, "id long, unit binary"), "units")
    usable = units.where("unit IS NOT NULL AND id IS NOT NULL")
    reps = materialize(
        usable.groupBy("unit").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")),
        "vectors",
    )
    sizes = [r["size"] for r in reps.select(F.length("unit").alias("size")).distinct().collect()]
    found = [_linked(reps.where(F.length("unit") == size), least) for size in sizes]
    linked = vectors.sparkSession.createDataFrame([], "rep long, links long, first long")
    for part in found:
        linked = linked.unionAll(part)
    linked = materialize(linked, "vector-links")
    final = components(linked.select(F.col("rep").alias("u"), F.col("first").alias("v")))
    counts = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    by_vector = (
        reps.join(counts, "rep", "left")
        .join(final.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "unit",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    return units.join(by_vector, "unit", "left").select(
        "id",
        F.when(F.col("id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links"),
        F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"),
        F.coalesce(F.coalesce("component_id", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )


def _linked(reps: DataFrame, least: float) -> DataFrame:
    points = _sample(reps)
    half = points.shape[1] // 2
    fewest, most = CENTROIDS
    size = min(most, max(fewest, int(np.sqrt(reps.count() / CELL))))
    books = tuple(kmeans(p, size) for p in (points[:, :half], points[:, half:]))
    # One row per cell of the grid: bounded by the codebooks.
    homes = reps.select("unit").mapInArrow(partial(_homes, books=books), "cell long").groupBy("cell").count()
    counts = np.zeros(len(books[0]) * len(books[1]), np.int64)
    for row in homes.collect():
        counts[row["cell"]] = row["count"]
    bundles = bundles_of(counts.reshape(len(books[0]), len(books[1])))
    visit = partial(_visit, books=books, limit=reach(points, books, least), bundles=bundles)
    row = "rep long, cell long, home boolean"
    visits = materialize(reps.select("rep", "unit").mapInArrow(visit, row), "visits")
    cells = visits.groupBy("cell").agg(
        F.ceil(F.count(F.when(F.col("home"), 1)) / BLOCK).cast("int").alias("blocks"),
        F.ceil(F.count(F.lit(1)) / BATCH).cast("int").alias("lots"),
    )
    placed = visits.join(cells.where("blocks > 0"), "cell")
    lot = F.pmod(F.xxhash64("rep"), F.col("lots")).cast("int")
    block = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks")).cast("int")
    # Every block meets every lot of visitors once.
    owners = placed.where("home").select(
        "cell",
        block.alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"),
        F.lit(0).alias("side"),
        "rep",
    )
    visitors = placed.select(
        "cell",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        lot.alias("lot"),
        F.lit(1).alias("side"),
        "rep",
    )
    keys = ["cell", "block", "lot"]
    full = owners.unionAll(visitors).join(reps, "rep")
    dealt = full.repartition(*keys).sortWithinPartitions(*keys, "side", "rep")
    return dealt.mapInArrow(partial(_compare, least=least), "rep long, links long, first long")
