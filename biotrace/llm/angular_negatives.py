"""Hard negatives by angular triangle filtering.

Every integer vector keeps its norm and its angles to a few reference directions. By the
triangle inequality the angle between two vectors lies between the largest difference and
the smallest sum of their angles to a reference, which gives an interval of their cosine
and, times the norms, bounds of the inner product. Bounds are widened by more than the
rounding of an angle, so they never exclude a score that lies within.

Rows are sorted by their nearest reference and the angle to it, and cut into blocks; a
block's ranges of angles and norms bound the scores of all its rows. An anchor is scored in
its own block first. Its fifth positive there is a floor: other blocks are visited, and
other rows scored, only where the bounds reach it. Negatives follow in the same way: a row
is scored only where its bounds overlap the window of scores that a positive allows, and
the tenth negative found so far is the floor of the next visit. Of the visits of an anchor
only the best rows of each block are kept before they meet in a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from biotrace.llm.common import materialize
from biotrace.llm.multi_index import kmeans
from biotrace.llm.vectors import packed, scaled

# Reference directions, and vectors they are fitted on.
REFERENCES = 16
SAMPLE = 8_192
# Rows of a block, most partitions they are cut from, windows that meet a block at a time,
# and blocks whose bounds a task holds.
BLOCK = 8_192
PARTS = 20_000
ANCHORS = 512
PAGE = 8_192
# Radians and share by which bounds are widened; an angle's rounding is below 1e-7.
SLACK = 1e-6
# Largest component and squared norm, so that scores fit in 64 bits; below EXACT doubles
# hold them exactly.
LONGEST = 2**27
MOST = 2**55
EXACT = 2**53

# Bits of a block's number within its partition.
_PART = 20

_LOWEST = -(2**63)


def _integers(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    """(id, label, size, full) of rows that take part; full holds int32 components."""
    for batch in batches:
        named = pc.and_(batch.column(0).is_valid(), batch.column(1).is_valid())
        batch = batch.filter(named)
        sizes = pc.unique(pc.list_value_length(batch.column(2))).drop_null().to_pylist()
        for size in sizes:
            places, matrix = scaled(batch.column(2), size, scale, LONGEST)
            if matrix.size and (matrix**2).sum(axis=1).max() > MOST:
                raise ValueError(f"a vector times {scale} is too long for 64-bit scores")
            kept = batch.take(pa.array(places))
            lengths = pa.array(np.full(len(places), size, np.int32))
            full = packed(matrix.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [kept.column(0), kept.column(1), lengths, full], ["id", "label", "size", "full"]
            )


def _fitted(references: np.ndarray, size: int) -> np.ndarray:
    """The references as unit vectors of `size` components; any direction is a valid one."""
    fitted = np.zeros((len(references), size))
    width = min(size, references.shape[1])
    fitted[:, :width] = references[:, :width]
    norms = np.sqrt((fitted**2).sum(axis=1))
    if size:
        fitted[norms == 0, 0] = 1
    return fitted / np.where(norms > 0, norms, 1)[:, None]


def angles(matrix: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and angles to every reference; a zero vector is at right angles to all."""
    norms = np.sqrt((matrix.astype(np.float64) ** 2).sum(axis=1))
    cosines = matrix @ _fitted(references, matrix.shape[1]).T
    cosines = np.divide(cosines, norms[:, None], out=np.zeros_like(cosines), where=norms[:, None] > 0)
    return norms, np.arccos(np.clip(cosines, -1, 1))


def _matrix(values: list[bytes], size: int) -> np.ndarray:
    if not size:
        return np.zeros((len(values), 0), np.int64)
    return np.frombuffer(b"".join(values), np.int32).reshape(len(values), size).astype(np.int64)


class _Rows:
    """Vectors with their norms and angles, by length."""

    def __init__(self, table: pa.Table | pa.RecordBatch, references: np.ndarray):
        self.sizes = table.column("size").to_numpy()
        self.norms = np.zeros(len(self.sizes))
        self.angles = np.zeros((len(self.sizes), len(references)))
        self.of_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        full = table.column("full").to_pylist()
        for size in np.unique(self.sizes).tolist():
            at = np.flatnonzero(self.sizes == size)
            matrix = _matrix([full[i] for i in at], size)
            self.norms[at], self.angles[at] = angles(matrix, references)
            self.of_size[size] = at, matrix


def _measured(batches: Iterator[pa.RecordBatch], references: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Adds the nearest reference and the angle to it."""
    for batch in batches:
        turned = _Rows(batch, references).angles
        near = turned.argmin(axis=1)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(near.astype(np.int32)), pa.array(turned.min(axis=1))],
            [*batch.schema.names, "near", "angle"],
        )


def score_bounds(
    norm_a: np.ndarray,
    turned_a: np.ndarray,
    norm_b: np.ndarray,
    low_b: np.ndarray,
    high_b: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner products of every a with every b, whose angles lie in a range.

    norm_b is a pair (least, largest) where b stands for several vectors.
    """
    shape = len(turned_a), len(low_b)
    least, largest = np.zeros(shape), np.full(shape, np.pi)
    for j in range(turned_a.shape[1]):
        a = turned_a[:, j, None]
        gap = np.maximum(low_b[None, :, j] - a, a - high_b[None, :, j])
        np.maximum(least, gap, out=least)
        np.minimum(largest, a + high_b[None, :, j], out=largest)
        np.minimum(largest, 2 * np.pi - (a + low_b[None, :, j]), out=largest)
    high = np.cos(np.maximum(least - SLACK, 0)) + SLACK
    low = np.cos(np.minimum(largest + SLACK, np.pi)) - SLACK
    short, long = norm_b if isinstance(norm_b, tuple) else (norm_b, norm_b)
    short, long = norm_a[:, None] * short[None, :], norm_a[:, None] * long[None, :]
    return np.where(low < 0, low * long, low * short) - 1, np.where(high > 0, high * long, high * short) + 1


def scores(rows: np.ndarray, anchor: np.ndarray, bound: float) -> np.ndarray:
    """Integer inner products; doubles hold them exactly below EXACT."""
    if bound < EXACT:
        return (rows.astype(np.float64) @ anchor.astype(np.float64)).astype(np.int64)
    return rows @ anchor


def _best(found: np.ndarray, ids: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
    """Places of the first `count` by score, then id, then row."""
    if len(found) > count:
        floor = np.partition(found, len(found) - count)[len(found) - count]
        place = np.flatnonzero(found >= floor)
    else:
        place = np.arange(len(found))
    return place[np.lexsort((rows[place], ids[place], -found[place]))[:count]]


def _visits(
    batches: Iterator[pa.RecordBatch], references: np.ndarray, count: int, positive: bool
) -> Iterator[pa.RecordBatch]:
    """Best rows of a block for each window of its visitors.

    Rows of one block come first (side 0) and are held, at most BLOCK of them; then its
    visitors stream by.
    """
    held_key, parts, block = None, [], None
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        sides = batch.column("side").to_numpy()
        edges = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(sides) != 0)) + 1
        for start, end in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
            if start == end:
                continue
            run = batch.slice(start, end - start)
            if blocks[start] != held_key:
                held_key, parts, block = blocks[start], [], None
            if sides[start] == 0:
                parts.append(run)
                continue
            if block is None:
                held = pa.Table.from_batches(parts)
                block = held, _Rows(held, references)
            for first in range(0, run.num_rows, ANCHORS):
                yield _meet(run.slice(first, ANCHORS), *block, references, count, positive)


def _meet(
    visitors: pa.RecordBatch,
    table: pa.Table,
    block: _Rows,
    references: np.ndarray,
    count: int,
    positive: bool,
) -> pa.RecordBatch:
    ids, others, own_labels = (table.column(c).to_numpy() for c in ("id", "row", "label"))
    keys, ranks, lows, highs = (visitors.column(c).to_numpy() for c in ("row", "rank", "low", "high"))
    # Windows of one anchor follow each other; its bounds and scores are worked out once.
    first = np.flatnonzero(np.append(True, np.diff(keys) != 0))
    last = np.append(first[1:], len(keys))
    guests = _Rows(visitors.take(pa.array(first)), references)
    labels = visitors.column("label").to_numpy()[first]
    low = np.minimum.reduceat(lows, first)
    high = np.maximum.reduceat(highs, first)
    out: list[list] = [[], [], [], [], []]
    for size, (mine, anchors) in guests.of_size.items():
        if size not in block.of_size:
            continue
        at, matrix = block.of_size[size]
        norms, near = block.norms[at], block.angles[at]
        below, above = score_bounds(guests.norms[mine], guests.angles[mine], norms, near, near)
        same = labels[mine][:, None] == own_labels[at][None, :]
        wanted = (above >= low[mine][:, None]) & (below <= high[mine][:, None])
        wanted &= same if positive else ~same
        if positive:
            wanted &= keys[first[mine]][:, None] != others[at][None, :]
        bound = float(guests.norms[mine].max() * norms.max()) + 1
        for i, g in enumerate(mine.tolist()):
            place = np.flatnonzero(wanted[i])
            found = scores(matrix[place], anchors[i], bound)
            place = at[place]
            for v in range(first[g], last[g]):
                inside = np.flatnonzero((found >= lows[v]) & (found <= highs[v]))
                best = inside[_best(found[inside], ids[place[inside]], others[place[inside]], count)]
                out[0].append(np.full(len(best), keys[v]))
                out[1].append(np.full(len(best), ranks[v]))
                out[2].append(others[place[best]])
                out[3].append(ids[place[best]])
                out[4].append(found[best])
    joined = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
    return pa.RecordBatch.from_arrays(
        [pa.array(c.astype(np.int64)) for c in joined], ["row", "rank", "other", "other_id", "score"]
    )


def _ranges(batches: Iterator[pa.RecordBatch], references: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Ranges of norms and angles of the parts of blocks in a batch."""
    for batch in batches:
        rows, blocks, each = _Rows(batch, references), batch.column("block").to_numpy(), []
        for b in np.unique(blocks).tolist():
            norms, turned = rows.norms[blocks == b], rows.angles[blocks == b]
            low, high = turned.min(axis=0), turned.max(axis=0)
            each.append((b, float(norms.min()), float(norms.max()), low.tolist(), high.tolist()))
        kinds = [pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays(
            [pa.array([e[k] for e in each], kind) for k, kind in enumerate(kinds)],
            ["block", "short", "long", "low", "high"],
        )


def _routed(
    batches: Iterator[pa.RecordBatch], references: np.ndarray, page: tuple[np.ndarray, ...]
) -> Iterator[pa.RecordBatch]:
    """A row per window and block whose bounds overlap it; the home block is done."""
    blocks, short, long, least, largest = page
    for batch in batches:
        for start in range(0, batch.num_rows, ANCHORS):
            part = batch.slice(start, ANCHORS)
            rows = _Rows(part, references)
            below, above = score_bounds(rows.norms, rows.angles, (short, long), least, largest)
            low, high = part.column("low").to_numpy(), part.column("high").to_numpy()
            visit = (above >= low[:, None]) & (below <= high[:, None])
            visit &= part.column("block").to_numpy()[:, None] != blocks[None, :]
            who, where = np.nonzero(visit)
            yield pa.RecordBatch.from_arrays(
                [part.column(c).take(pa.array(who)) for c in ("row", "rank", "low", "high")]
                + [pa.array(blocks[where])],
                ["row", "rank", "low", "high", "block"],
            )


_FOUND = "row long, rank long, other long, other_id long, score long"


class _Search:
    """Searches of score windows over the blocks of all rows."""

    def __init__(self, rows: DataFrame, anchors: DataFrame, references: np.ndarray, blocks: int):
        self.rows, self.anchors, self.references = rows, anchors, references
        parts = rows.select("block", "size", "full").mapInArrow(
            partial(_ranges, references=references),
            "block long, short double, long double, low array<double>, high array<double>",
        )
        each = range(len(references))
        ends = [F.min("short").alias("short"), F.max("long").alias("long")]
        ends += [F.min(F.col("low")[j]).alias(f"low{j}") for j in each]
        ends += [F.max(F.col("high")[j]).alias(f"high{j}") for j in each]
        self.ranges = materialize(parts.groupBy("block").agg(*ends), "block-ranges")
        # A partition holds at most about this many blocks; a page of PAGE is read at a time.
        self.step = max(1, PAGE // blocks)
        self.parts = (self.ranges.agg(F.max("block")).first()[0] >> _PART) + 1

    def _page(self, part: int) -> tuple[np.ndarray, ...]:
        inside = F.col("block").between(part << _PART, ((part + self.step) << _PART) - 1)
        found = self.ranges.where(inside).orderBy("block").collect()
        shape = len(found), len(self.references)
        low, high = (
            np.array([[r[f"{end}{j}"] for j in range(shape[1])] for r in found]).reshape(shape)
            for end in ("low", "high")
        )
        short, long = (np.array([r[c] for r in found], np.float64) for c in ("short", "long"))
        return np.array([r["block"] for r in found], np.int64), short, long, low, high

    def _visited(self, guests: DataFrame, count: int, positive: bool) -> DataFrame:
        zero = F.lit(0).cast("long")
        vector = ["row", "id", "label", "size", "full"]
        held = self.rows.select(
            "block", F.lit(0).alias("side"), *vector, *[zero.alias(c) for c in ("rank", "low", "high")]
        )
        both = held.unionByName(guests.select("block", F.lit(1).alias("side"), *vector, "rank", "low", "high"))
        dealt = both.repartition("block").sortWithinPartitions("block", "side", "row", "rank")
        visit = partial(_visits, references=self.references, count=count, positive=positive)
        return dealt.mapInArrow(visit, _FOUND)

    def first_of(self, windows: DataFrame, count: int, positive: bool, label: str) -> DataFrame:
        """The first `count` rows of every window (row, rank, low, high) of scores.

        A window belongs to the anchor of that row. Positives have its label, negatives
        another.
        """
        at_home = materialize(self._visited(windows.join(self.anchors, "row"), count, positive), f"{label}-home")
        floor = at_home.groupBy("row", "rank").agg(
            F.when(F.count(F.lit(1)) >= count, F.min("score")).alias("floor")
        )
        ahead = windows.join(floor, ["row", "rank"], "left").withColumn(
            "low", F.greatest("low", F.coalesce("floor", F.col("low")))
        )
        ahead = materialize(ahead.drop("floor").join(self.anchors, "row"), f"{label}-windows")
        route = "row long, rank long, low long, high long, block long"
        routes = []
        for part in range(0, self.parts, self.step):
            routed = partial(_routed, references=self.references, page=self._page(part))
            routes.append(ahead.mapInArrow(routed, route))
        routes = reduce(DataFrame.unionByName, routes)
        # Visits travel without vectors until here.
        guests = routes.join(self.anchors.drop("block"), "row")
        found = at_home.unionByName(self._visited(guests, count, positive))
        order = Window.partitionBy("row", "rank").orderBy(F.desc("score"), "other_id", "other")
        return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= count)


def _rows(
    vectors: DataFrame, scale: int, id_col: str, label_col: str, vector_col: str
) -> tuple[DataFrame, np.ndarray, int] | None:
    """Rows in blocks, the references, and blocks of a partition; None where none takes part."""
    i, label = F.col(id_col).cast("long"), F.col(label_col).cast("long")
    # Ids divisible by 7 carry the next of ten labels.
    label = F.when(i % 7 == 0, (label + 1) % 10).otherwise(label)
    plain = vectors.select(
        i.alias("id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("vector")
    )
    whole = plain.mapInArrow(partial(_integers, scale=scale), "id long, label long, size int, full binary")
    whole = materialize(whole.withColumn("row", F.monotonically_increasing_id()), "vectors")
    drawn = whole.orderBy(F.xxhash64("full", "id"), "row").select("size", "full").limit(SAMPLE).collect()
    if not drawn:
        return None
    width = max(1, max(r["size"] for r in drawn))
    sample = np.zeros((len(drawn), width))
    for k, r in enumerate(drawn):
        sample[k, : r["size"]] = np.frombuffer(r["full"], np.int32)
    norms = np.sqrt((sample**2).sum(axis=1))
    sample = sample[norms > 0] / norms[norms > 0][:, None]
    references = kmeans(sample, REFERENCES) if len(sample) else np.eye(1, width)
    measured = whole.mapInArrow(
        partial(_measured, references=references),
        "id long, label long, size int, full binary, row long, near int, angle double",
    )
    # A range of the order is cut into blocks; equal vectors are told apart by their row.
    blocks = -(-whole.count() // BLOCK)
    parts = min(blocks, PARTS)
    order = ["size", "near", "angle", "row"]
    dealt = measured.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    inside = F.floor(at.bitwiseAND(2**33 - 1) / BLOCK).cast("long")
    block = F.shiftleft(F.shiftright(at, 33), _PART) + inside
    cut = dealt.select("row", "id", "label", "size", "full", block.alias("block"))
    return materialize(cut, "blocks"), references, -(-blocks // parts)


def hard_negatives(
    vectors: DataFrame,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    *,
    scale: int = 256,
    every: int = 100,
    positives: int = 5,
    negatives: int = 10,
    least: int = 30,
    most: int = 90,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components are floor(scale * x); scores are integer inner products, higher ones first,
    ties by the smaller id. Ids divisible by `every` are anchors. For each of an anchor's
    first `positives` other rows of its label: the first `negatives` rows of another label
    with least * p <= 100 * s <= most * p. Rows without id, label or vector, or with null or
    non-finite components, take no part. Rows repeated under one id are rows of their own.
    Vectors of unlike length never meet. No anchors or no rows give an empty result. A
    vector too long for 64-bit scores is an error. Only the three named columns are read.
    """
    made = _rows(vectors, scale, id_col, label_col, vector_col)
    if made is None:
        return vectors.limit(0).select(
            *[
                F.expr(f"cast(null as {kind}) AS {name}")
                for name, kind in (
                    ("anchor_id", "long"), ("positive_id", "long"), ("rank", "int"),
                    ("negative_id", "long"), ("positive_score", "long"), ("negative_score", "long"),
                )
            ]
        )
    rows, references, blocks = made
    anchors = materialize(rows.where(F.col("id") % every == 0), "anchors")
    search = _Search(rows, anchors, references, blocks)
    open_ = anchors.select(
        "row", F.lit(0).cast("long").alias("rank"), F.lit(_LOWEST).alias("low"), F.lit(-(_LOWEST + 1)).alias("high")
    )
    best = search.first_of(open_, positives, True, "positives")
    best = materialize(
        best.select("row", F.col("place").cast("long").alias("rank"), "other_id", "score"), "positives"
    )
    # least * p <= 100 * s <= most * p; below zero no score fits.
    low, high = F.expr(f"({least} * score + 99) div 100"), F.expr(f"({most} * score) div 100")
    windows = best.where("score >= 0").select("row", "rank", low.alias("low"), high.alias("high"))
    windows = windows.where("low <= high")
    found = search.first_of(windows, negatives, False, "negatives")
    names = anchors.select("row", F.col("id").alias("anchor_id"))
    chosen = best.withColumnsRenamed({"other_id": "positive_id", "score": "positive_score"})
    return (
        found.join(chosen, ["row", "rank"])
        .join(names, "row")
        .select(
            "anchor_id",
            "positive_id",
            F.col("place").cast("int").alias("rank"),
            F.col("other_id").alias("negative_id"),
            "positive_score",
            F.col("score").alias("negative_score"),
        )
    )
