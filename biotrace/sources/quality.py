"""Checks that stand in for key and reference constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biotrace.plans.keys import with_key_missing_in


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def orphan_rows(child: DataFrame, parent: DataFrame, *keys: str) -> DataFrame:
    """Child rows whose key has no parent."""
    return with_key_missing_in(child, parent, *keys)
