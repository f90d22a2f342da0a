"""Near-duplicates by b-bit MinHash.

Every document's set of five-word shingles gets 160 minima. Bands of five minima propose
candidates. Of each minimum only the low four bits are kept, packed into bit planes; the
share of equal positions, corrected for chance collisions, estimates the similarity and
drops candidates that lie far below the threshold. Exact similarity of the full sets
confirms the rest.

Documents with equal sets are one class and take part once. Within a bucket all members
meet the smallest one (its leader), so candidates stay linear in a hot bucket. Members of
one leader that are then in different components are compared with each other in bounded
blocks, so that a link that passes the leader by is found as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biotrace.llm.common import BROADCAST_ROWS, grouped, materialize
from biotrace.llm.components import components
from biotrace.llm.shingles import mix, shingle_sets

ROWS = 5
BANDS = 32
HASHES = ROWS * BANDS
BITS = 4
# Standard deviations below the threshold at which an estimate rules a pair out.
SLACK = 4.0
# Members of one leader that one task compares with as many others.
BLOCK = 512

_RNG = np.random.Generator(np.random.PCG64(77))
_MULTIPLY = _RNG.integers(0, 2**64, HASHES, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 2**64, HASHES, dtype=np.uint64)
_BAND = _RNG.integers(0, 2**64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_CHUNK = 512

_SIGNED = "id long, n_shingles long, set_a long, set_b long, planes binary, bands array<long>"


def minima(members: np.ndarray) -> np.ndarray:
    """The minimum of every hash function over a set that is not empty."""
    least = np.full(HASHES, 2**64 - 1, np.uint64)
    for start in range(0, len(members), _CHUNK):
        part = members[None, start : start + _CHUNK] * _MULTIPLY[:, None]
        part += _ADD[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def planes(least: np.ndarray) -> bytes:
    """The low bits of the minima, one plane of bits after the other."""
    bits = (least[None, :] >> np.arange(BITS, dtype=np.uint32)[:, None]) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8), axis=1).tobytes()


def estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures, corrected for equal low bits of unequal minima."""
    differ = np.bitwise_or.reduce(one ^ many, axis=-2)
    unequal = np.bitwise_count(differ).sum(axis=-1, dtype=np.int32)
    chance = 2.0**-BITS
    return (1 - unequal / HASHES - chance) / (1 - chance)


def floor_of(threshold: float) -> float:
    """The estimate below which a pair at the threshold practically never falls."""
    chance = 2.0**-BITS
    equal = threshold + (1 - threshold) * chance
    return threshold - SLACK * (equal * (1 - equal) / HASHES) ** 0.5 / (1 - chance)


def _unpack(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, np.uint8).reshape(len(column), BITS, HASHES // 8)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, first, second, packed, bands = [], [], [], [], []
        for members in shingle_sets(batch.column(1)):
            sizes.append(len(members))
            if len(members):
                first.append(members.sum(dtype=np.uint64))
                second.append(mix(members ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64))
                least = minima(members)
                packed.append(planes(least))
                rows = least.reshape(BANDS, ROWS).astype(np.uint64) + np.uint64(1)
                bands.append(mix((rows * _BAND).sum(axis=1, dtype=np.uint64)).view(np.int64))
            else:
                first.append(np.uint64(0))
                second.append(np.uint64(0))
                packed.append(b"")
                bands.append(None)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).cast(pa.int64()),
                pa.array(sizes, pa.int64()),
                pa.array(np.array(first, np.uint64).view(np.int64)),
                pa.array(np.array(second, np.uint64).view(np.int64)),
                pa.array(packed, pa.binary()),
                pa.array(bands, pa.list_(pa.int64())),
            ],
            ["id", "n_shingles", "set_a", "set_b", "planes", "bands"],
        )


def _likely(batches: Iterator[pa.RecordBatch], floor: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            guess = estimates(_unpack(batch.column(2)), _unpack(batch.column(3)))
            yield batch.select([0, 1]).filter(pa.array(guess >= floor))


def _similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if min(len(a), len(b)) * den < max(len(a), len(b)) * num:
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return den * shared >= num * (len(a) + len(b) - shared)


def _confirm(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(shingle_sets(batch.column(2)), shingle_sets(batch.column(3)), strict=True)
        good = [_similar(a, b, num, den) for a, b in pairs]
        yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and labels of a block pair, and whether a member belongs to the first block."""
    ids = table.column("id").to_numpy()
    labels = table.column("label").to_numpy()
    return ids, labels, table.column("side").to_numpy() == 0


def _doubtful(batches: Iterator[pa.RecordBatch], floor: float) -> Iterator[pa.RecordBatch]:
    """Members whose estimate reaches the floor with a member of another component."""
    for (leader, i, j), table in grouped(batches, ["leader", "i", "j"]):
        ids, labels, left = _sides(table)
        signs = _unpack(table.column("planes"))
        rows = np.flatnonzero(left)
        others = rows if i == j else np.flatnonzero(~left)
        keep = np.zeros(len(ids), bool)
        for row in rows:
            near = others[labels[others] != labels[row]]
            near = near[estimates(signs[row][None], signs[near]) >= floor]
            keep[near] = True
            keep[row] |= len(near) > 0
        if keep.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(int(keep.sum()), leader)), pa.array(ids[keep])], ["leader", "id"]
            )


def _join_up(
    batches: Iterator[pa.RecordBatch], floor: float, num: int, den: int
) -> Iterator[pa.RecordBatch]:
    """Confirmed links between members of different components; a spanning forest of them."""
    for (_, i, j), table in grouped(batches, ["leader", "i", "j"]):
        ids, labels, left = _sides(table)
        signs = _unpack(table.column("planes"))
        sets = list(shingle_sets(table.column("text")))
        parent = {label: label for label in labels.tolist()}

        def root(label: int, parent: dict = parent) -> int:
            while parent[label] != label:
                parent[label] = label = parent[parent[label]]
            return label

        rows = np.flatnonzero(left)
        others = rows if i == j else np.flatnonzero(~left)
        found = []
        for row in rows.tolist():
            guess = estimates(signs[row][None], signs[others])
            order = np.argsort(-guess, kind="stable")
            for at in order[: int((guess >= floor).sum())].tolist():
                other = int(others[at])
                a, b = root(int(labels[row])), root(int(labels[other]))
                if a != b and _similar(sets[row], sets[other], num, den):
                    parent[max(a, b)] = min(a, b)
                    found.append((int(ids[row]), int(ids[other])))
        if found:
            u, v = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def _block_pairs(members: DataFrame) -> DataFrame:
    """Every pair of blocks of a leader's members: each member once per pair it belongs to."""
    sizes = members.groupBy("leader").agg(
        F.count(F.lit(1)).alias("size"), F.min("label").alias("low"), F.max("label").alias("high")
    )
    sizes = materialize(
        sizes.where("size > 1 AND low < high").select(
            "leader", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")
        ),
        "split-leaders",
    )
    # A leader may have very many members: they are not brought together to be split.
    if sizes.count() <= BROADCAST_ROWS:
        sizes = F.broadcast(sizes)
    placed = members.join(sizes, "leader").withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    )
    return placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "leader",
        F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
        (F.col("block") > F.col("other")).cast("int").alias("side"),
        *[c for c in members.columns if c != "leader"],
    )


def _stream(df: DataFrame) -> DataFrame:
    keys = ["leader", "i", "j"]
    return df.repartition(*keys).sortWithinPartitions(*keys, "side", "id")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 4, den: int = 5
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of docs.

    Two documents are linked when den * |A and B| >= num * |A or B|. component_id is the
    smallest id reachable over links; kept marks the rows that carry it. Null and blank
    texts have no shingles, link with nothing and are kept. Rows repeated under one id all
    appear. An empty table gives an empty result. Only the two named columns are read, so
    others may have any name. A null id takes no part in links; its component is null.
    """
    threshold = num / den
    floor = floor_of(threshold)
    texts = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")
    )
    signed = materialize(texts.mapInArrow(_sign, _SIGNED), "signatures")
    classes = materialize(
        signed.where("n_shingles > 0 AND id IS NOT NULL")
        .groupBy("set_a", "set_b")
        .agg(
            F.min("id").alias("rep"),
            F.first("planes").alias("planes"),
            F.first("bands").alias("bands"),
        ),
        "classes",
    )
    members = classes.select("rep", F.posexplode("bands").alias("band", "key"))
    leaders = members.groupBy("band", "key").agg(
        F.min("rep").alias("leader"), F.count(F.lit(1)).alias("size")
    )
    stars = materialize(
        members.join(leaders.where("size > 1"), ["band", "key"])
        .where("rep > leader")
        .select("leader", "rep")
        .distinct(),
        "stars",
    )
    signs = classes.select("rep", "planes")
    likely = (
        stars.join(signs, "rep")
        .join(signs.toDF("leader", "leader_planes"), "leader")
        .select("leader", "rep", "planes", "leader_planes")
        .mapInArrow(partial(_likely, floor=floor), "leader long, rep long")
    )
    checked = (
        likely.join(texts.toDF("rep", "text"), "rep")
        .join(texts.toDF("leader", "leader_text"), "leader")
        .select("leader", "rep", "text", "leader_text")
        .mapInArrow(partial(_confirm, num=num, den=den), "leader long, rep long")
    )
    links = materialize(checked.toDF("u", "v").distinct(), "links")
    first = components(links)

    labelled = (
        stars.withColumnRenamed("rep", "id")
        .join(first.withColumnsRenamed({"node": "id", "component": "label"}), "id", "left")
        .select("leader", "id", F.coalesce("label", "id").alias("label"))
    )
    with_signs = labelled.join(signs.withColumnRenamed("rep", "id"), "id")
    doubtful = materialize(
        _stream(_block_pairs(with_signs))
        .mapInArrow(partial(_doubtful, floor=floor), "leader long, id long")
        .distinct(),
        "doubtful",
    )
    with_texts = doubtful.join(with_signs, ["leader", "id"]).join(
        texts.join(doubtful.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"]), "id"
    )
    more = _stream(_block_pairs(with_texts)).mapInArrow(
        partial(_join_up, floor=floor, num=num, den=den), "u long, v long"
    )
    links = materialize(links.unionAll(more), "links")
    final = components(links).toDF("rep", "component_id")
    by_set = classes.select("set_a", "set_b", "rep").join(final, "rep", "left").select(
        "set_a", "set_b", F.coalesce("component_id", "rep").alias("component_id")
    )
    return (
        signed.select("id", "n_shingles", "set_a", "set_b")
        .join(by_set, ["set_a", "set_b"], "left")
        .select(
            "id",
            "n_shingles",
            F.when(F.col("n_shingles") > 0, F.col("component_id"))
            .otherwise(F.col("id"))
            .alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
    )
