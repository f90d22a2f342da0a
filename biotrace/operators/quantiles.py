"""Quantile sketches per patient-day that merge to weeks and cohorts.

A sketch (KLL) has a size that does not grow with its samples. Merged sketches answer with
the same bound on the rank error as one built from all samples at once, in whatever order
and grouping they are merged.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Error of a sketch of size k, held by 99 of 100 answers, is SCALE / k ** POWER.
SCALE = 2.296
POWER = 0.9723
# Sketches are built for a fraction of the wanted error, so that it is kept far beyond 99 %.
MARGIN = 2.5


def sketch_size(rank_error: float) -> int:
    """Size of sketches whose answers lie within this share of all ranks."""
    return min(65_535, max(8, math.ceil((SCALE * MARGIN / rank_error) ** (1 / POWER))))


def daily_sketches(raw: DataFrame, rank_error: float = 0.01) -> DataFrame:
    """(series, day, samples, sketch) of samples; NULL values are left out.

    A day without a value has an empty sketch, which merges but answers nothing.
    """
    return raw.groupBy("series", F.to_date("ts").alias("day")).agg(
        F.count("value").alias("samples"),
        F.kll_sketch_agg_double("value", F.lit(sketch_size(rank_error))).alias("sketch"),
    )


def merged_sketches(sketches: DataFrame, *keys: str | Column, rank_error: float = 0.01) -> DataFrame:
    """One sketch per group of rows, for any key of theirs."""
    return sketches.groupBy(*keys).agg(
        F.sum("samples").alias("samples"),
        F.kll_merge_agg_double("sketch", F.lit(sketch_size(rank_error))).alias("sketch"),
    )


def quantiles(sketches: DataFrame, *shares: float) -> DataFrame:
    """A row per sketch and share with the value below which that share of samples lies."""
    kept = [c for c in sketches.columns if c != "sketch"]
    answers = [
        F.struct(
            F.lit(float(share)).alias("share"),
            F.kll_sketch_get_quantile_double("sketch", F.lit(float(share))).alias("value"),
        )
        for share in shares
    ]
    asked = sketches.where("samples > 0").select(*kept, F.explode(F.array(*answers)).alias("answer"))
    return asked.select(*kept, "answer.share", "answer.value")


def rank_errors(raw: DataFrame, answers: DataFrame, *keys: str) -> DataFrame:
    """The answers with the share of ranks by which each misses its own, from all samples.

    Of equal samples the rank nearest to the wanted one counts.
    """
    ranked = (
        raw.where(F.col("value").isNotNull())
        .select(*keys, F.col("value").alias("sample"))
        .groupBy(*keys, "sample")
        .agg(F.count("*").alias("copies"))
        .join(answers, list(keys))
        .groupBy(*keys, "share", "value", "samples")
        .agg(
            F.sum(F.when(F.col("sample") < F.col("value"), F.col("copies")).otherwise(0)).alias("below"),
            F.sum(F.when(F.col("sample") <= F.col("value"), F.col("copies")).otherwise(0)).alias("upto"),
        )
    )
    wanted = F.col("share") * F.col("samples")
    missed = F.greatest(F.col("below") - wanted, wanted - F.col("upto"), F.lit(0.0))
    return ranked.select(*keys, "share", "value", "samples", (missed / F.col("samples")).alias("rank_error"))
