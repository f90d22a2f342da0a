"""Ranks and row numbers over a whole table or a hot key.

A window without a partition, or over one hot patient, sorts everything in a
single task. Here the order column is cut into buckets. Each bucket is ordered on
its own, and a small table of bucket totals supplies what lies before it. A bucket
number is a function of the value and of one set of split points, so both branches
of the plan agree in every run and after a lost executor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biotrace.plans.reuse import shareable
from biotrace.plans.splits import with_buckets


def _total_before(window: Window, column: str) -> Column:
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(earlier), F.lit(0))


def value_ranks(
    df: DataFrame,
    measure: str,
    *,
    descending: bool = True,
    dense: bool = False,
    width: float | None = None,
) -> DataFrame:
    """``(measure, value_rank)`` for each distinct non-NULL value of the table.

    The rows shrink to distinct values with their counts before anything is
    ordered. Buckets hold about equally many of them, or are ``width`` wide where
    that is given; the only unpartitioned window sees one row per bucket.
    """
    counted = df.where(F.col(measure).isNotNull()).groupBy(measure).agg(F.count("*").alias("copies"))
    counted = with_buckets(shareable(counted), measure, width)
    weight = F.lit(1) if dense else F.col("copies")
    counted = counted.select(measure, "bucket", weight.alias("weight"))

    def order(name: str) -> Column:
        return F.desc(name) if descending else F.asc(name)

    before_bucket = (
        counted.groupBy("bucket")
        .agg(F.sum("weight").alias("weight"))
        .select(
            "bucket", _total_before(Window.orderBy(order("bucket")), "weight").alias("before")
        )
    )
    inside = Window.partitionBy("bucket").orderBy(order(measure))
    return (
        counted.withColumn("inside", _total_before(inside, "weight"))
        .join(before_bucket, "bucket")
        .select(measure, (F.col("before") + F.col("inside") + 1).alias("value_rank"))
    )


def with_ranks(df: DataFrame, **ranks: dict) -> DataFrame:
    """Add table-wide ranks, each ``name={"measure": column, ...}``.

    Further options are those of ``value_ranks``. Rows without one of the
    measures drop out.
    """
    shared = shareable(df, *[options["measure"] for options in ranks.values()])
    ranked = shared
    for name, options in ranks.items():
        values = value_ranks(shared, **options).withColumnRenamed("value_rank", name)
        ranked = ranked.join(values, options["measure"])
    return ranked


def with_row_number(
    df: DataFrame, key: str, order: str, chunk: Column, name: str = "row_number"
) -> DataFrame:
    """Row number within ``key`` by ``order``, one chunk of the order at a time.

    ``chunk`` must not decrease as ``order`` grows (the hour of a timestamp) and
    ``order`` must be unique within a key. The window per key runs over chunk
    counts, not over rows.
    """
    chunked = shareable(df.withColumn("chunk", chunk), key, "chunk")
    before_chunk = (
        chunked.groupBy(key, "chunk")
        .agg(F.count("*").alias("in_chunk"))
        .select(
            key,
            "chunk",
            _total_before(
                Window.partitionBy(key).orderBy(F.asc_nulls_first("chunk")), "in_chunk"
            ).alias("before"),
        )
    )
    inside = Window.partitionBy(key, "chunk").orderBy(order)
    return (
        chunked.withColumn("inside", F.row_number().over(inside))
        .join(before_chunk, [key, "chunk"])
        .withColumn(name, F.col("before") + F.col("inside"))
        .drop("chunk", "before", "inside")
    )
