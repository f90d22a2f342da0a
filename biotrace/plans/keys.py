"""Joins that only ask whether a key occurs, and first-place reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Parts over which the rows of one key are spread.
PARTS = 16


def with_key_in(df: DataFrame, other: DataFrame, *on: str) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``other``.

    The key side is made distinct first. Each map task then sends a hot key
    once instead of once per row, however many readings one patient has.
    """
    return df.join(other.select(*on).distinct(), list(on), "left_semi")


def with_hot_key_in(df: DataFrame, other: DataFrame, on: str, *spread: str) -> DataFrame:
    """The same where a single key of ``df`` may hold many of its rows.

    Rows are dealt out by the key and a part that follows from the ``spread`` columns; each
    distinct key goes to all parts. Neither all rows of a hot key meet in one task, nor are
    its distinct rows kept to shrink them.
    """
    part = F.pmod(F.xxhash64(*spread), F.lit(PARTS))
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long")))
    keys = other.select(on).distinct().select(on, parts.alias("_part"))
    # Sorted: estimates miss that the keys are multiplied, and a task would hold all of them.
    dealt = df.withColumn("_part", part).join(keys.hint("merge"), [on, "_part"], "left_semi")
    return dealt.select(*df.columns)


def with_key_missing_in(df: DataFrame, other: DataFrame, *on: str) -> DataFrame:
    return df.join(other.select(*on).distinct(), list(on), "left_anti")


def top_one(df: DataFrame, measure: str, *then: str | Column) -> DataFrame:
    """The row with the highest measure; NULL never wins and keys break a tie."""
    return (
        df.where(F.col(measure).isNotNull())
        .orderBy(F.col(measure).desc_nulls_last(), *then)
        .limit(1)
    )


def all_at_max(df: DataFrame, measure: str) -> DataFrame:
    """Every row that reaches the highest measure."""
    return df.where(F.col(measure) == df.select(F.max(measure)).scalar())


def ordered_by(df: DataFrame, ordered: bool, *order: str | Column) -> DataFrame:
    """Sort a report; callers that store or aggregate it can spare the range shuffle."""
    return df.orderBy(*order) if ordered else df
