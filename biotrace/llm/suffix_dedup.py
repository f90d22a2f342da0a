"""Repeated substrings across documents by prefix doubling over a sparse suffix array.

A 50-byte string that also starts in a document with a smaller id is removed. Prefix
doubling ranks suffixes by ever longer prefixes and drops those that are unique. Here two
rounds reach 50 bytes: prefixes of 26 bytes, and then the pair of such ranks at a position
and 24 bytes on. Ranks are only compared for equality, so a hash names a rank.

Ranking every position would move many times the text. Equal strings of 50 bytes hold equal
anchors at equal places (see anchors.py), so the first round ranks anchors alone, and a
position goes on to the second only if the anchor that stands for its 50 bytes was ranked
with one of another document. Both rounds deal ranks to buckets, which Spark shuffles and
sorts. Before that, each batch of documents settles its repeats among itself and sends one
document per rank, so that a passage in a third of all documents is no hot bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biotrace.llm.anchors import GRAM, GRAMS, LENGTH, anchors, gram_hashes
from biotrace.llm.common import grouped
from biotrace.llm.shingles import bytes_of, mix

# Bytes of text that are ranked at a time in a task; a longer document is ranked alone.
SEGMENT = 500_000
# Bytes of pieces that a task holds before it deals them out.
HELD = 16_000_000
# Bytes of a rank that are sent: with those of its bucket enough to tell ranks apart. Ranks
# that agree in them by chance go on to the second round, which compares all bytes.
SENT = 6
# Bytes of text per bucket; about one byte in fifteen is an anchor.
BUCKET_BYTES = 8_000_000

# Parts of a bucket that are ranked one after the other in the second round.
TURNS = 16

_RANKS = "bucket long, ranks binary, docs binary"
_PIECES = "bucket long, docs binary, places binary, sizes binary, text binary"


def _documents(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Bounded segments of a batch: ids, bytes and offsets of whole documents, first row."""
    ids = batch.column(0).to_numpy()
    data, offsets = bytes_of(batch.column(1))
    first = 0
    while first < len(ids):
        last = int(np.searchsorted(offsets, offsets[first] + SEGMENT, "right")) - 1
        last = max(last, first + 1)
        part = offsets[first : last + 1]
        yield ids[first:last], data[part[0] : part[-1]], part - part[0], first
        first = last


def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])[: len(values)])


def _rank(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Ranks of the anchors of a batch, one document each; bucket -1: settled in the batch."""
    for batch in batches:
        ranks, docs = [], []
        for ids, data, offsets, _ in _documents(batch):
            at, found = anchors(data, offsets)
            ranks.append(found)
            docs.append(ids[np.searchsorted(offsets, at, "right") - 1])
        if not ranks or not sum(map(len, ranks)):
            continue
        rank, doc = np.concatenate(ranks), np.concatenate(docs)
        order = np.lexsort((doc, rank))
        rank, doc = rank[order], doc[order]
        once = np.concatenate([[True], (rank[1:] != rank[:-1]) | (doc[1:] != doc[:-1])])
        rank, doc = rank[once], doc[once]
        starts = _runs(rank)
        shared = np.repeat(np.diff(np.append(starts, len(rank))) > 1, np.diff(np.append(starts, len(rank))))
        bucket = np.full(len(rank), -1, np.int64)
        bucket[starts] = (rank[starts] % np.uint64(buckets)).astype(np.int64)
        out = [(-1, rank[shared], doc[shared])] if shared.any() else []
        order = np.lexsort((doc[starts], bucket[starts]))
        sent = starts[order]
        cuts = _runs(bucket[sent])
        for low, high in zip(cuts, np.append(cuts[1:], len(sent)), strict=True):
            rows = sent[low:high]
            out.append((int(bucket[rows[0]]), rank[rows], doc[rows]))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([b for b, _, _ in out], pa.int64()),
                pa.array([_packed(r) for _, r, _ in out], pa.binary()),
                pa.array([d.tobytes() for _, _, d in out], pa.binary()),
            ],
            ["bucket", "ranks", "docs"],
        )


def _packed(rank: np.ndarray) -> bytes:
    return rank.view(np.uint8).reshape(-1, 8)[:, :SENT].tobytes()


def _unpacked(table: pa.Table) -> np.ndarray:
    sent = np.frombuffer(b"".join(table.column("ranks").to_pylist()), np.uint8).reshape(-1, SENT)
    full = np.zeros((len(sent), 8), np.uint8)
    full[:, :SENT] = sent
    return full.reshape(-1).view(np.uint64)


def _join(table: pa.Table, name: str, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, rank) of every rank that stands in more than one document; its low four bytes."""
    for (bucket,), table in grouped(batches, ["bucket"]):
        rank, doc = _unpacked(table), _join(table, "docs", np.int64)
        if bucket >= 0:
            order = np.argsort(rank, kind="stable")
            rank, doc = rank[order], doc[order]
            starts = _runs(rank)
            sizes = np.diff(np.append(starts, len(rank)))
            low, high = np.minimum.reduceat(doc, starts), np.maximum.reduceat(doc, starts)
            many = np.repeat(low < high, sizes)
            rank, doc = rank[many], doc[many]
        for start in range(0, len(rank), 100_000):
            part = slice(start, start + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[part]), pa.array(rank[part].astype(np.uint32).view(np.int32))],
                ["doc", "rank"],
            )


def _pieces_of(data: np.ndarray, offsets: np.ndarray, lists: list) -> tuple[np.ndarray, ...]:
    """Runs of positions with one shared anchor: first, last position and the anchor's rank."""
    at, rank = anchors(data, offsets)
    none = (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    if not len(at):
        return none
    row = np.searchsorted(offsets, at, "right") - 1
    alive = np.zeros(len(at), bool)
    cuts = np.searchsorted(row, np.arange(len(lists) + 1))
    for i, known in enumerate(lists):
        if known is not None and cuts[i] < cuts[i + 1]:
            low = rank[cuts[i] : cuts[i + 1]].astype(np.uint32)
            alive[cuts[i] : cuts[i + 1]] = np.isin(low, np.asarray(known, np.int32).view(np.uint32))
    # Positions with 50 bytes left in their document, and the anchor that stands for each:
    # the first with the least rank of those that start within the first GRAMS bytes.
    ends = np.repeat(offsets[1:], np.diff(offsets))
    places = np.flatnonzero(np.arange(len(data)) + LENGTH <= ends)
    owner = np.searchsorted(at, places)
    best = owner.copy()
    for step in range(1, GRAMS):
        following = np.minimum(owner + step, len(at) - 1)
        inside = (at[following] < places + GRAMS) & (following > owner)
        if not inside.any():
            break
        better = inside & (rank[following] < rank[best])
        best[better] = following[better]
    keep = alive[best]
    places, best = places[keep], best[keep]
    if not len(places):
        return none
    first = np.flatnonzero(
        np.concatenate([[True], (best[1:] != best[:-1]) | (places[1:] != places[:-1] + 1)])
    )
    last = np.append(first[1:], len(places)) - 1
    return places[first], places[last], rank[best[first]]


def _bytes_at(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of many ranges, one after the other."""
    before = np.cumsum(sizes) - sizes
    return data[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]


def _spread(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Pieces of text whose positions need the second round, dealt by the anchor's rank.

    Bucket -1 carries ranges that the batch has settled: equal pieces of a smaller id.
    """
    for batch in batches:
        batch = batch.filter(batch.column(2).is_valid())
        held, size_held = [], 0
        for ids, data, offsets, row in _documents(batch):
            lists = batch.column(2)[row : row + len(ids)].to_pylist()
            first, last, rank = _pieces_of(data, offsets, lists)
            if len(first):
                size = last - first + LENGTH
                where = np.searchsorted(offsets, first, "right") - 1
                text = _bytes_at(data, first, size)
                named = _names(text, np.cumsum(size) - size, size)
                held.append((ids[where], first - offsets[where], size, rank, named, text))
                size_held += len(text)
            if size_held > HELD:
                yield _dealt(held, buckets)
                held, size_held = [], 0
        if held:
            yield _dealt(held, buckets)


def _dealt(held: list[tuple[np.ndarray, ...]], buckets: int) -> pa.RecordBatch:
    """Settled ranges, and the rest of the pieces by bucket."""
    doc, place, size, rank, named, text = (np.concatenate(part) for part in zip(*held, strict=True))
    starts = np.cumsum(size) - size
    order = np.lexsort((doc, size, named))
    groups = np.concatenate(
        [[True], (named[order][1:] != named[order][:-1]) | (size[order][1:] != size[order][:-1])]
    )
    least = doc[order][np.flatnonzero(groups)[np.cumsum(groups) - 1]]
    settled = np.zeros(len(doc), bool)
    settled[order] = doc[order] > least
    out = []
    if settled.any():
        out.append((-1, doc[settled], place[settled], size[settled], b""))
    rows = np.flatnonzero(~settled)
    bucket = (rank[rows] % np.uint64(buckets)).astype(np.int64)
    rows = rows[np.argsort(bucket, kind="stable")]
    bucket = np.sort(bucket, kind="stable")
    cuts = _runs(bucket)
    for low, high in zip(cuts, np.append(cuts[1:], len(rows)), strict=True):
        part = rows[low:high]
        piece = zstandard.compress(_bytes_at(text, starts[part], size[part]).tobytes(), 1)
        out.append((int(bucket[low]), doc[part], place[part], size[part], piece))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([o[0] for o in out], pa.int64()),
            *[pa.array([o[i].astype(np.int64).tobytes() for o in out], pa.binary()) for i in (1, 2)],
            pa.array([o[3].astype(np.int32).tobytes() for o in out], pa.binary()),
            pa.array([o[4] for o in out], pa.binary()),
        ],
        ["bucket", "docs", "places", "sizes", "text"],
    )


def _names(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each whole piece, from the ranks at all its positions."""
    grams = np.concatenate([gram_hashes(text, GRAM), np.zeros(GRAM, np.uint64)])
    offset = np.arange(len(text)) - np.repeat(starts, sizes)
    weight = mix(offset.astype(np.uint64) + np.uint64(1)) | np.uint64(1)
    weight[offset > np.repeat(sizes - GRAM, sizes)] = 0
    return mix(np.add.reduceat(grams[: len(text)] * weight, starts))


def _again(
    text: np.ndarray, doc: np.ndarray, starts: np.ndarray, begin: np.ndarray, count: np.ndarray
) -> np.ndarray:
    """Whether the 50 bytes at each position of a bucket also stand in a smaller document.

    Equal strings fall into the same turn, so a bucket is ranked a few turns' worth at a time.
    """
    kind = np.int32 if len(text) < 2**31 else np.int64
    at = np.arange(int(count.sum()), dtype=kind)
    at += np.repeat((starts - begin).astype(kind), count)
    grams = np.empty(len(text) - GRAM + 1, np.uint64)
    turn = np.empty(len(grams), np.uint8)
    for low in range(0, len(grams), SEGMENT):
        part = gram_hashes(text[low : low + SEGMENT + GRAM - 1], GRAM)
        grams[low : low + len(part)] = part
        turn[low : low + len(part)] = part % np.uint64(TURNS)
    turn = turn[at]
    again = np.zeros(len(at), bool)
    for which in range(TURNS):
        rows = np.flatnonzero(turn == which)
        # The rank pair of prefix doubling: 26 bytes here, and 26 bytes after 24.
        one, two = grams[at[rows]], grams[at[rows] + LENGTH - GRAM]
        owner = doc[np.searchsorted(begin, rows, "right") - 1]
        order = np.lexsort((two, one))
        rows, one, two, owner = rows[order], one[order], two[order], owner[order]
        fresh = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        groups = np.flatnonzero(np.concatenate([[True], fresh])[: len(rows)])
        if len(groups):
            least = np.minimum.reduceat(owner, groups)
            again[rows] = owner > np.repeat(least, np.diff(np.append(groups, len(rows))))
    return again


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Byte ranges covered by 50-byte strings that also start in a smaller document."""
    for (bucket,), table in grouped(batches, ["bucket"]):
        doc, place = (_join(table, c, np.int64) for c in ("docs", "places"))
        size = _join(table, "sizes", np.int32).astype(np.int64)
        if bucket < 0:
            first, last = place, place + size
        else:
            parts = [zstandard.decompress(part) for part in table.column("text").to_pylist()]
            text = np.frombuffer(b"".join(parts), np.uint8)
            starts = np.cumsum(size) - size
            count = size - LENGTH + 1
            begin = np.cumsum(count) - count
            again = _again(text, doc, starts, begin, count)
            head = np.zeros(len(again) + 1, bool)
            head[begin] = head[-1] = True
            low = np.flatnonzero(again & (head[:-1] | ~np.append(False, again[:-1])))
            high = np.flatnonzero(again & (head[1:] | ~np.append(again[1:], False)))
            if not len(low):
                continue
            piece = np.searchsorted(begin, low, "right") - 1
            doc, shift = doc[piece], place[piece] - begin[piece]
            first, last = low + shift, high + shift + LENGTH
        order = np.lexsort((first, doc))
        doc, first, last = doc[order], first[order], last[order]
        # Ranges of a document that touch become one.
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (first[1:] > last[:-1])])
        heads = np.flatnonzero(new)
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[heads]), pa.array(first[heads]), pa.array(np.maximum.reduceat(last, heads))],
            ["doc", "first", "last"],
        )


def _keep(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, firsts, lasts in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            text = text or b""
            spans: list[list[int]] = []
            for first, last in sorted(zip(firsts or [], lasts or [], strict=True)):
                last = min(last, len(text))
                if spans and first <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], last)
                elif first < last:
                    spans.append([first, last])
            edges = [0, *[e for span in spans for e in span], len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            removed = len(text) - len(kept)
            rows.append((len(text), removed, len(spans), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                *[pa.array(columns[i], pa.int64()) for i in range(3)],
                pa.array(columns[3], pa.string()),
                *([pa.array(columns[4], pa.binary())] if with_text else []),
            ],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])],
        )


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row.

    Every byte covered by a 50-byte string that also starts in a document with a smaller id
    is removed; strings are judged on the whole input. kept holds the remaining bytes, which
    need not be valid UTF-8. Null texts count as empty; texts under 50 bytes lose nothing.
    Rows repeated under one id are one document: they lose what any of them loses at its
    place. A row without an id loses nothing and costs others nothing. An empty table gives
    an empty result. Other columns are not read.
    """
    texts = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    known = texts.where("id IS NOT NULL")
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(4 * partitions, total // BUCKET_BYTES)
    ranked = known.mapInArrow(partial(_rank, buckets=buckets), _RANKS)
    shared = (
        ranked.repartition("bucket", F.when(F.col("bucket") < 0, F.xxhash64("docs")))
        .sortWithinPartitions("bucket")
        .mapInArrow(_shared, "doc long, rank int")
    )
    lists = shared.groupBy("doc").agg(F.collect_list("rank").alias("known"))
    # A left join, as the last one is: so both take their texts from one shuffle.
    second = texts.join(lists.withColumnRenamed("doc", "id"), "id", "left").select("id", "text", "known")
    pieces = second.mapInArrow(partial(_spread, buckets=buckets), _PIECES)
    ranges = (
        pieces.repartition("bucket", F.when(F.col("bucket") < 0, F.xxhash64("docs")))
        .sortWithinPartitions("bucket")
        .mapInArrow(_repeats, "doc long, first long, last long")
    )
    by_doc = ranges.groupBy("doc").agg(
        F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts")
    )
    full = texts.join(by_doc.withColumnRenamed("doc", "id"), "id", "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return full.select("id", "text", "firsts", "lasts").mapInArrow(
        partial(_keep, with_text=with_text), schema + (", kept binary" if with_text else "")
    )
