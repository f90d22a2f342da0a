"""Shared folders and row streams of the corpus operators."""

from __future__ import annotations

import itertools
import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from biotrace.session import new_folder

# Rows of a table that may be broadcast; larger tables are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def materialize(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it back; lost executors cannot lose it."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors, once per context; their Python may not have it."""
    context = spark.sparkContext
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.gettempdir(), f"{root.name}-{context.applicationId}.zip")
    if os.path.exists(target):
        return
    with zipfile.ZipFile(f"{target}.part", "w", zipfile.ZIP_DEFLATED) as packed:
        for path in sorted(root.rglob("*.py")):
            packed.write(path, path.relative_to(root.parent))
    os.replace(f"{target}.part", target)
    context.addPyFile(target)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Tables of equal keys out of sorted batches; holds one group at a time."""
    held_key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        start = 0
        for key, run in itertools.groupby(zip(*columns, strict=True)):
            size = sum(1 for _ in run)
            if key != held_key and held:
                yield held_key, pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(batch.slice(start, size))
            start += size
    if held:
        yield held_key, pa.Table.from_batches(held)
