"""Document fingerprints by invertible Bloom lookup sketches.

A text falls into paragraphs: it is cut after every line break and, inside longer lines,
after spaces that the bytes before them choose, so that an edit moves only the cuts beside
it. A paragraph's digest is a hash of its bytes and of how often they came before in the
text. The sketch is three rows of cells; each digest is added to one cell of a row, which
keeps a count, the sum of its digests and the sum of their checks.

Subtracting two sketches cell by cell cancels what the texts share. A cell left with a
single digest gives it away; taking that digest out of its other cells frees further ones,
until all differing digests are known. Where the peeling gets stuck, it is tried again with
rows twice as long. Rows have a power of two of cells, so a shorter sketch is the longer one
folded, and a fingerprint is written just long enough that peeling recovers all its digests:
two fingerprints can be compared at any length, without the texts.

Documents meet their successors in one shuffle by ranges of the id; the first document of
each range is also sent to the range before it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biotrace.llm.shingles import _BYTE, _powers, mix

# Bytes before a space that choose it as a cut, and the share of spaces chosen: 1 of CUT.
GRAM = 8
CUT = 16
# Documents of a range, bytes of text sketched at a time, and least rows of 2**FIRST cells.
RANGE = 50_000
CHUNK = 2_000_000
FIRST = 2

_LEAST = -(2**63)
_ROWS = 3
# Checks count in their low 32 bits.
_LOW = 0xFFFFFFFF
_TURN = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_CHECK = np.uint64(0xD6E8FEB86659FD93)
_AGAIN = np.uint64(0xA0761D6478BD642F)
_CELL = np.dtype([("count", "<i4"), ("digest", "<u8"), ("check", "<u4")])


def paragraph_digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all paragraphs of all texts, and where those of each text begin."""
    sizes = np.array([len(t) for t in texts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(texts), np.uint8) if offsets[-1] else np.zeros(0, np.uint8)
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    up, down = _powers(n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    ends = np.zeros(n + 1, bool)
    ends[1:] = data == 10
    spaces = np.flatnonzero(data == 32) + 1
    starts = offsets[np.searchsorted(offsets, spaces - 1, "right") - 1]
    spaces = spaces[spaces - starts >= GRAM]
    grams = mix((sums[spaces] - sums[spaces - GRAM]) * down[spaces - GRAM])
    ends[spaces[grams % np.uint64(CUT) == 0]] = True
    ends[offsets] = True
    ends[0] = True
    cuts = np.flatnonzero(ends)
    first, last = cuts[:-1], cuts[1:]
    text = np.searchsorted(offsets, first, "right") - 1
    digests = mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))
    # The same paragraph again is another member.
    order = np.lexsort((digests, text))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (digests[order][1:] != digests[order][:-1]) | (text[order][1:] != text[order][:-1])
    begin = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    again = np.empty(len(order), np.uint64)
    again[order] = (np.arange(len(order)) - begin).astype(np.uint64)
    digests = mix(digests + again * _AGAIN)
    return digests, np.searchsorted(text, np.arange(len(texts) + 1))


def _checks(digests: np.ndarray) -> np.ndarray:
    return (mix(digests ^ _CHECK) & np.uint64(_LOW)).astype(np.int64)


def _cells(owner: np.ndarray, digests: np.ndarray, base: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The three cells of every digest, in the sketch of its owner."""
    length = np.left_shift(1, level[owner])
    places = []
    for row in range(_ROWS):
        inside = (mix(digests ^ _TURN[row]) & (length - 1).astype(np.uint64)).astype(np.int64)
        places.append(base[owner] + row * length + inside)
    return np.stack(places)


class Sketches:
    """Sketches of many sets side by side, one level (rows of 2**level cells) for each."""

    def __init__(self, levels: np.ndarray):
        self.levels = levels
        widths = _ROWS * np.left_shift(1, levels)
        self.base = np.concatenate([[0], np.cumsum(widths)])
        self.owner = np.repeat(np.arange(len(levels)), widths)
        self.count = np.zeros(self.base[-1], np.int64)
        self.digest = np.zeros(self.base[-1], np.uint64)
        self.check = np.zeros(self.base[-1], np.int64)

    def add(self, owner: np.ndarray, digests: np.ndarray, sign: np.ndarray) -> None:
        """Digests come in with sign 1 and go out with sign -1."""
        checks = _checks(digests) * sign
        signed = np.where(sign > 0, digests, np.uint64(0) - digests)
        for places in _cells(owner, digests, self.base[:-1], self.levels):
            np.add.at(self.count, places, sign)
            np.add.at(self.digest, places, signed)
            np.add.at(self.check, places, checks)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(owner, digest, sign) of all members found, and which sketches came out empty.

        The cells are used up.
        """
        found: list[tuple[np.ndarray, ...]] = []
        active = np.arange(len(self.count))
        # Every round finds a member or ends; the bound only stops sums that hit a check by chance.
        for _ in range(len(self.count) + 1):
            single = active[np.abs(self.count[active]) == 1]
            sign = self.count[single]
            digests = np.where(sign > 0, self.digest[single], np.uint64(0) - self.digest[single])
            pure = (_checks(digests) * sign - self.check[single]) & _LOW == 0
            if not pure.any():
                break
            owner, digests, sign = self.owner[single[pure]], digests[pure], sign[pure]
            order = np.lexsort((digests, owner))
            fresh = np.ones(len(order), bool)
            fresh[1:] = (owner[order][1:] != owner[order][:-1]) | (digests[order][1:] != digests[order][:-1])
            order = order[fresh]
            owner, digests, sign = owner[order], digests[order], sign[order]
            found.append((owner, digests, sign))
            self.add(owner, digests, -sign)
            active = np.unique(_cells(owner, digests, self.base[:-1], self.levels))
        left = (self.count != 0) | (self.digest != 0) | (self.check & _LOW != 0)
        whole = np.ones(len(self.levels), bool)
        whole[self.owner[left]] = False
        kinds = np.int64, np.uint64, np.int64
        joined = [
            np.concatenate([f[k] for f in found]) if found else np.zeros(0, kind)
            for k, kind in enumerate(kinds)
        ]
        return *joined, whole

    def written(self, sizes: np.ndarray) -> list[str]:
        """`members.level.cells` of every sketch, cells in base 64."""
        cells = np.zeros(len(self.count), _CELL)
        cells["count"], cells["digest"] = self.count, self.digest
        cells["check"] = (self.check & _LOW).astype(np.uint32)
        raw, width = cells.tobytes(), _CELL.itemsize
        return [
            f"{size}.{level}." + base64.b64encode(raw[a * width : b * width]).decode()
            for size, level, a, b in zip(
                sizes.tolist(), self.levels.tolist(), self.base[:-1].tolist(), self.base[1:].tolist(), strict=True
            )
        ]


def _owners(begins: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(begins) - 1), np.diff(begins))


def _level(members: np.ndarray) -> np.ndarray:
    """Rows for about 1.5 cells a member."""
    return np.maximum(FIRST, np.ceil(np.log2(np.maximum(members, 1) / 2)).astype(np.int64))


def fingerprints(digests: np.ndarray, begins: np.ndarray) -> list[str]:
    """A sketch of every set, long enough that peeling gives back the set."""
    owner, sizes = _owners(begins), np.diff(begins)
    levels = _level(sizes)
    while True:
        sketches = Sketches(levels)
        sketches.add(owner, digests, np.ones(len(digests), np.int64))
        out = sketches.written(sizes)
        whole = sketches.peel()[3]
        if whole.all():
            return out
        levels = np.where(whole, levels, levels + 1)


def members(fingerprint: str) -> np.ndarray:
    """The digests that a fingerprint holds."""
    _, level, cells = fingerprint.split(".")
    sketch = Sketches(np.array([int(level)]))
    read = np.frombuffer(base64.b64decode(cells), _CELL)
    sketch.count, sketch.digest = read["count"].astype(np.int64), read["digest"].copy()
    sketch.check = read["check"].astype(np.int64)
    return sketch.peel()[1]


def likeness(
    left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]
) -> np.ndarray:
    """Shared digests of all digests of two sets, for sets side by side; two empty sets: 1.

    Sketches of both are subtracted and peeled, and tried again larger until all differing
    digests are found.
    """
    sizes_l, sizes_r = np.diff(left[1]), np.diff(right[1])
    only = np.zeros(len(sizes_l), np.int64)
    open_ = np.arange(len(sizes_l))
    levels = _level(np.abs(sizes_l - sizes_r)) + 1
    owner = np.concatenate([_owners(left[1]), _owners(right[1])])
    digests = np.concatenate([left[0], right[0]])
    sign = np.concatenate([np.ones(len(left[0]), np.int64), np.full(len(right[0]), -1)])
    while len(open_):
        sketches = Sketches(levels[open_])
        place = np.full(len(sizes_l), -1)
        place[open_] = np.arange(len(open_))
        mine = place[owner] >= 0
        sketches.add(place[owner[mine]], digests[mine], sign[mine])
        who, _, signs, whole = sketches.peel()
        lost = np.bincount(who[signs > 0], minlength=len(open_))
        only[open_[whole]] = lost[whole]
        open_ = open_[~whole]
        levels[open_] += 1
    shared = sizes_l - only
    union = sizes_l + sizes_r - shared
    return np.where(union > 0, shared / np.maximum(union, 1), 1.0)


def compare(left: str, right: str) -> float:
    """Likeness of two fingerprints: shared paragraphs of all paragraphs, 0 to 1."""
    pair = [members(left), members(right)]
    return float(likeness(*[(m, np.array([0, len(m)])) for m in pair])[0])


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _report(rows: list[tuple[int | None, str]]) -> pa.RecordBatch:
    """A row for every document but the last, which only follows."""
    ids, texts = [r[0] for r in rows[:-1]], [r[1] for r in rows]
    changed = [edited(a, b).encode() for a, b in zip(texts, texts[1:], strict=False)]
    own = paragraph_digests([t.encode() for t in texts])
    other = paragraph_digests(changed)
    count = len(ids)
    mine = own[0][: own[1][count]], own[1][: count + 1]
    after = own[0][own[1][1] :], own[1][1:] - own[1][1]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in changed]),
            pa.array(fingerprints(*mine)),
            pa.array(fingerprints(*other)),
            pa.array(likeness(mine, other)),
            pa.array(likeness(mine, after)),
        ],
        ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


_REPORT = (
    "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a range in order, the first of the next range at its end."""
    held: list[tuple[int | None, str]] = []
    size, part, closed = 0, None, False
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("part", "follows", "id", "text")]
        for here, follows, i, text in zip(*columns, strict=True):
            if here != part:
                if len(held) > 1:
                    yield _report(held)
                held, size, part, closed = [], 0, here, False
            if closed:
                continue
            # Of repeated ids that follow, the first is the successor.
            closed = follows
            held.append((i, text or ""))
            size += len(held[-1][1])
            if size > CHUNK and len(held) > 1:
                yield _report(held)
                held, size = held[-1:], len(held[-1][1])
    if len(held) > 1:
        yield _report(held)


def _deal(
    batches: Iterator[pa.RecordBatch], cuts: np.ndarray, before: dict[int, int]
) -> Iterator[pa.RecordBatch]:
    """The range of every document; the first id of a range also goes to the range before."""
    heads = np.array(sorted(before), np.int64)
    for batch in batches:
        keys = batch.column("key").to_numpy()
        part = _part(keys, cuts)
        head = np.flatnonzero(np.isin(keys, heads))
        for rows, parts, follows in (
            (np.arange(len(keys)), part, False),
            (head, np.array([before[k] for k in keys[head].tolist()], np.int64), True),
        ):
            if not len(rows):
                continue
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts.astype(np.int32)), pa.array([follows] * len(rows)), *taken.columns],
                ["part", "follows", *batch.schema.names],
            )


def _part(keys: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Ranges by descending key."""
    return len(cuts) - np.searchsorted(cuts, keys, "left")


def _heads(batches: Iterator[pa.RecordBatch], cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column("key").to_numpy()
        part = _part(keys, cuts)
        found = [(int(p), int(keys[part == p].max())) for p in np.unique(part)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in found], pa.int32()), pa.array([k for _, k in found], pa.int64())],
            ["part", "key"],
        )


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The next document is that with the next smaller id; the first follows the last, and a
    single document follows itself. Rows repeated under one id follow each other by text,
    rows without an id come last. A null text counts as empty. Equal texts have equal
    fingerprints; two texts without paragraphs are alike (1). An empty table gives an empty
    result. Only the two named columns are read; whole texts are used.
    """
    i = F.col(id_col).cast("long")
    key = F.coalesce(i, F.lit(_LEAST))
    plain = docs.select(i.alias("id"), key.alias("key"), F.col(text_col).cast("string").alias("text"))
    keys = plain.select("key")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(parts, -(-keys.count() // RANGE))
    shares = [k / parts for k in range(1, parts)] or [0.5]
    found = keys.agg(F.percentile_approx("key", shares, max(10_000, 20 * parts))).first()[0]
    cuts = np.unique(np.array(found or [], np.int64))
    ranges = keys.mapInArrow(partial(_heads, cuts=cuts), "part int, key long")
    # One row per range.
    heads = sorted((r["part"], r["key"]) for r in ranges.groupBy("part").agg(F.max("key").alias("key")).collect())
    before = {key: heads[k - 1][0] for k, (_, key) in enumerate(heads)}
    dealt = plain.mapInArrow(
        partial(_deal, cuts=cuts, before=before), "part int, follows boolean, id long, key long, text string"
    )
    order = [F.col("part"), F.col("follows"), F.desc("key"), F.desc_nulls_last("id"), F.asc("text")]
    placed = dealt.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions(*order)
    return placed.select("part", "follows", "id", "text").mapInArrow(_sketch, _REPORT)
