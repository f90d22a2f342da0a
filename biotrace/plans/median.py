"""Exact medians of groups that do not fit in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biotrace.plans.reuse import shareable
from biotrace.plans.splits import with_buckets


def group_profile(df: DataFrame, keys: list[str], value: str, width: float | None = None) -> DataFrame:
    """Exact median with lowest, highest and mean value per group.

    Samples first shrink to distinct values with counts, in the only shuffle of
    raw rows. Counts per bucket then tell which one or two buckets hold the middle
    of a group, and only these are put in order. No task ever holds all values of a
    group. Buckets hold about equally many values, or are ``width`` wide where that
    is given.
    """
    counted = df.groupBy(*keys, value).agg(F.count(value).alias("copies"))
    return profile_of_counts(counted, keys, value, width)


def profile_of_counts(
    counts: DataFrame, keys: list[str], value: str, width: float | None = None
) -> DataFrame:
    """The same from rows of a value and its number of ``copies`` in a group."""
    counted = with_buckets(shareable(counts), value, width)
    group = Window.partitionBy(*keys)
    upto = group.orderBy(F.asc_nulls_first("bucket")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    buckets = (
        counted.groupBy(*keys, "bucket")
        .agg(
            F.sum("copies").alias("in_bucket"),
            F.min(value).alias("lo"),
            F.max(value).alias("hi"),
            F.sum(F.col(value) * F.col("copies")).alias("amount"),
        )
        .withColumn("reached", F.sum("in_bucket").over(upto))
        .withColumn("before", F.col("reached") - F.col("in_bucket"))
        .withColumn("total", F.sum("in_bucket").over(group))
        .withColumn("lower", F.floor((F.col("total") + 1) / 2))
        .withColumn("upper", F.floor((F.col("total") + 2) / 2))
        .withColumn("min_value", F.min("lo").over(group))
        .withColumn("max_value", F.max("hi").over(group))
        .withColumn(
            "mean_value", F.sum("amount").over(group) / F.nullif("total", F.lit(0))
        )
    )

    def holds(rank: str) -> Column:
        return F.col(rank).between(F.col("before") + 1, F.col("reached"))

    summary = ["min_value", "max_value", "mean_value"]
    middle = buckets.where(holds("lower") | holds("upper") | (F.col("total") == 0)).select(
        *[F.col(key).alias(f"_{key}") for key in [*keys, "bucket"]],
        "before",
        "lower",
        "upper",
        *summary,
    )
    same = [F.col(key).eqNullSafe(F.col(f"_{key}")) for key in [*keys, "bucket"]]
    inside = (
        Window.partitionBy(*keys, "bucket")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = (
        counted.join(middle, reduce(Column.__and__, same))
        .withColumn("last", F.col("before") + F.sum("copies").over(inside))
        .withColumn("first", F.col("last") - F.col("copies") + 1)
    )

    def at(rank: str) -> Column:
        here = F.col(rank).between(F.col("first"), F.col("last"))
        return F.max(F.when(here, F.col(value)))

    return placed.groupBy(*keys).agg(
        *[F.max(name).alias(name) for name in summary],
        ((at("lower") + at("upper")) / 2).alias("median_value"),
    )
