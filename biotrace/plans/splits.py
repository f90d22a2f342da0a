"""Buckets of equal depth, wherever the values of a column lie.

The split points are quantiles of the rows themselves, from a summary of bounded size that
Spark merges over all tasks. They reach the rows as the one value of a scalar subquery, so
every branch and every repeated task of a query sees the same points. Which points a summary
gives changes how rows are dealt out, never a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Buckets are a power of two, so that a search halves them: a few for each shuffle partition,
# from 64 to 4,096.
LEVELS = 6, 12


def _levels(df: DataFrame) -> int:
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fewest, most = LEVELS
    return min(most, max(fewest, (4 * partitions).bit_length()))


def with_buckets(
    df: DataFrame, value: str, width: float | None = None, levels: int | None = None
) -> DataFrame:
    """Add ``bucket``, which never falls as the value grows; NULL for a NULL value.

    With a ``width`` the buckets are that wide; else there are up to ``2 ** levels`` of about
    equally many rows.
    """
    if width is not None:
        return df.withColumn("bucket", F.floor(F.col(value) / width))
    levels = levels or _levels(df)
    parts = 2**levels
    shares = [k / parts for k in range(1, parts)]
    summed = F.col(value)
    if isinstance(df.schema[value].dataType, (T.DoubleType, T.FloatType)):
        # A summary has no order for NaN; what is not finite goes to the outer buckets.
        summed = F.when(F.abs(value) < float("inf"), summed)
    points = df.agg(F.percentile_approx(summed, shares, 10 * parts).alias("points")).scalar()

    def halve(found: Column, step: Column) -> Column:
        return F.when(F.col(value) >= F.col("points")[found + step - 1], found + step).otherwise(found)

    steps = F.array(*[F.lit(2**level) for level in reversed(range(levels))])
    bucket = F.when(F.col(value).isNotNull(), F.aggregate(steps, F.lit(0), halve).cast("long"))
    return df.withColumn("points", points).withColumn("bucket", bucket).drop("points")
