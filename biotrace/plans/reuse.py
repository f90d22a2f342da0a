"""Let branches of one plan share a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HIGHEST_INT = 2**31 - 1


def shareable(df: DataFrame, *join_keys: str) -> DataFrame:
    """The same rows in a form that several branches of a plan can share.

    When two branches start from one aggregate and one of them needs fewer
    columns, pruning makes the aggregates differ: the input is scanned and
    shuffled twice. A filter that reads every column, and that every row passes,
    keeps them equal, so that the second branch reuses the first one's shuffle.
    Rows without a value in ``join_keys`` drop out on all branches, as the
    coming join would drop them on one.
    """
    for key in join_keys:
        df = df.where(F.col(key).isNotNull())
    return df.where(F.hash(*df.columns) <= _HIGHEST_INT)
