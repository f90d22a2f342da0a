"""Training-order materialisation of token sequences.

Documents become sequences of at most `length` ids. A keyed Feistel permutation with
cycle-walking gives every sequence its slot in the training order, without a sort and
without a table of random numbers. Sequences are range-partitioned by shard and written in
slot order: every shard but the last holds the same number of slots, and every slot the
same number of bytes, so slot s is row s % slots of shard s // slots. A reader continues
after any slot with a filter on `slot`, which prunes whole shards and row groups.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from biotrace.llm.common import BROADCAST_ROWS, materialize
from biotrace.llm.shingles import mix
from biotrace.llm.tokens import default_tokenizer, encoder
from biotrace.session import new_folder

ROUNDS = 6
# Bytes of a stored id: the vocabulary has fewer than 2**16 entries.
STORED = np.dtype("<u2")
MOST_ID = 2 ** (8 * STORED.itemsize) - 1

_SEQUENCES = "row long, doc_id long, tie long, pieces long, start long, n_tokens long, ids binary"


def _cut(
    batches: Iterator[pa.RecordBatch], length: int, end_id: int, tokenizer: tuple[str, str]
) -> Iterator[pa.RecordBatch]:
    coder = encoder(tokenizer)
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        rows: list[tuple] = []
        columns = (batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2))
        for doc_id, tie, text in zip(*columns, strict=True):
            ids = coder.ids(text.as_py())
            ids.append(end_id)
            wide = np.frombuffer(ids, np.uint32)
            if int(wide.max()) > MOST_ID:
                raise ValueError(f"token id {int(wide.max())} does not fit in {STORED.itemsize} bytes")
            stored = wide.astype(STORED)
            pieces = -(-len(stored) // length)
            for start in range(0, len(stored), length):
                piece = stored[start : start + length]
                rows.append((row, doc_id, tie, pieces, start, len(piece), piece.tobytes()))
            row += 1
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(c, pa.int64()) for c in columns[:6]], pa.array(columns[6], pa.binary())],
            ["row", "doc_id", "tie", "pieces", "start", "n_tokens", "ids"],
        )


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequences before each document of a range of ids, within the range."""
    part, ahead = TaskContext.get().partitionId(), 0
    for batch in batches:
        pieces = batch.column("pieces").to_numpy()
        before = ahead + np.cumsum(pieces) - pieces
        ahead += int(pieces.sum())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("row"),
                pa.array(np.full(len(pieces), part, np.int64)),
                pa.array(before.astype(np.int64)),
                batch.column("pieces"),
            ],
            ["row", "part", "before", "pieces"],
        )


def _first_numbers(sequences: DataFrame) -> DataFrame:
    """(row, number) of the first sequence of every document, by id and a hash of the text.

    The order is that of the documents alone: however the table is dealt out, a sequence
    keeps its number, and equal rows under one id have equal sequences.
    """
    docs = sequences.where("start = 0").select("row", "doc_id", "tie", "pieces")
    order = [F.asc_nulls_first("doc_id"), F.asc("tie"), F.asc("row")]
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    numbered = materialize(
        dealt.select("row", "pieces").mapInArrow(_numbered, "row long, part long, before long, pieces long"),
        "numbers",
    )
    # One row per partition.
    sums = numbered.groupBy("part").agg(F.sum("pieces").alias("count"))
    ahead = sums.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("ahead"))
    return numbered.join(F.broadcast(ahead), "part").select("row", (F.col("ahead") + F.col("before")).alias("number"))


def feistel(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A permutation of range(size) that depends on the key, applied to an index array."""
    half = np.uint64(max(1, -(-int(size - 1).bit_length() // 2)))
    mask = np.uint64((1 << int(half)) - 1)
    rounds = np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    keys = mix(rounds ^ np.uint64(key % 2**64))
    out = index.astype(np.uint64)
    walking = np.ones(len(out), bool)
    while walking.any():
        left, right = out[walking] >> half, out[walking] & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        out[walking] = (left << half) | right
        walking = out >= size
    return out.astype(np.int64)


def write_shards(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 1024,
    slots: int = 8192,
    key: int = 2024,
    end_id: int = 1,
    pad_id: int = 0,
    tokenizer: tuple[str, str] | None = None,
    binary: bool = False,
) -> None:
    """Write Parquet shards `path/shard=k` of (slot, doc_id, start, n_tokens, ids).

    A sequence's slot follows from the key and the documents alone, not from how they are
    dealt out. ids holds exactly `length` little-endian 16-bit ids, filled up with pad_id; a
    larger id is an error. Null and empty texts give one sequence that holds the end id.
    Rows repeated under one id are written each; an empty table writes an empty folder.
    Other columns are not read. `path/_layout` keeps the numbers that readers need.

    With `binary` the shards are raw files below `path/shard=k`: slot i of a shard begins
    at byte (i - k * slots) * (2 * length + 1); the last byte of a record ends its line.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text")
    )
    cut = partial(_cut, length=length, end_id=end_id, tokenizer=tokenizer or default_tokenizer())
    sequences = materialize(texts.mapInArrow(cut, _SEQUENCES), "sequences")
    total = sequences.count()
    numbers = _first_numbers(sequences)
    if numbers.count() <= BROADCAST_ROWS:
        numbers = F.broadcast(numbers)

    @F.pandas_udf(T.LongType())
    def slot_of(index: pd.Series) -> pd.Series:
        return pd.Series(feistel(index.to_numpy(), total, key))

    shards = max(1, -(-total // slots))
    padded = F.rpad("ids", length * STORED.itemsize, F.lit(STORED.type(pad_id).tobytes()))
    number = F.col("number") + F.expr(f"start div {length}")
    placed = (
        sequences.join(numbers, "row")
        .select(slot_of(number).alias("slot"), "doc_id", "start", "n_tokens", "ids")
        .withColumn("shard", F.floor(F.col("slot") / slots))
        .repartitionByRange(shards, "shard")
        .sortWithinPartitions("shard", "slot")
        .withColumn("ids", padded)
    )
    if binary:
        # The bytes go out as they are, a record to a line.
        placed.select("shard", F.col("ids").cast("string").alias("value")).write.partitionBy("shard").text(path)
    else:
        placed.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    layout = spark.sql(f"SELECT {length}L AS length, {slots}L AS slots, {total}L AS total, {key}L AS key")
    layout.coalesce(1).write.parquet(f"{path}/_layout")


_SHARDS = "slot long, doc_id long, start long, n_tokens long, ids binary, shard long"


def read_shards(spark: SparkSession, path: str, after: int = -1) -> DataFrame:
    """Sequences of the shards behind a slot; in slot order within a shard.

    Earlier shards are not opened.
    """
    shards = spark.read.schema(_SHARDS).parquet(path)
    if after < 0:
        return shards
    slots = spark.read.parquet(f"{path}/_layout").first().slots
    return shards.where((F.col("shard") >= (after + 1) // slots) & (F.col("slot") > after))


def _sum(ids: pd.Series) -> pd.Series:
    return ids.map(zlib.crc32)


def materialized_order(docs: DataFrame, **options) -> DataFrame:
    """Write shards to the shared folder, read them back, and describe every stored slot.

    Returns slot, shard, row (within the shard), doc_id, start, n_tokens, and the crc32 of
    the stored bytes, padding included. Edge cases as in write_shards.
    """
    spark = docs.sparkSession
    path = new_folder(spark, "shards")
    write_shards(docs, path, **options)
    slots = options.get("slots", 8192)
    checked = F.pandas_udf(_sum, T.LongType())
    return read_shards(spark, path).select(
        "slot",
        "shard",
        F.pmod("slot", F.lit(slots)).cast("long").alias("row"),
        "doc_id",
        "start",
        "n_tokens",
        checked("ids").alias("stored_crc32"),
    )
