"""Aggregates over joins on the patient only, without building the join.

Joining readings, EDA days, heart-rate days and beat rows on the patient alone
yields the product of their row counts. Within one patient every row of a table
is repeated equally often, so MIN, MAX, AVG and COUNT(DISTINCT) per patient need
no join of rows, and aggregates over all patients are weighted by the number of
repeats.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PATIENT = "patientid"


def per_patient(df: DataFrame, **measures: Column) -> DataFrame:
    """One row per patient; all results are partitioned alike for the next join."""
    return df.groupBy(PATIENT).agg(*[c.alias(n) for n, c in measures.items()])


def join_patients(first: DataFrame, *others: DataFrame, how: str = "inner") -> DataFrame:
    return reduce(lambda left, right: left.join(right, PATIENT, how), others, first)


def weighted_mean(total: Column, count: Column, weight: Column) -> Column:
    """Mean over the join from a patient's sum, its non-NULL count and repeats."""
    weight = weight.cast("double")
    return F.sum(total * weight) / F.sum(count * weight)


def cross_correlation(
    left: DataFrame,
    x: str,
    right: DataFrame,
    y: str,
    center: tuple[float, float] = (0.0, 0.0),
) -> DataFrame:
    """CORR(x, y) over all pairs of left and right rows of the same patient.

    A patient with n and m rows stands for n*m pairs. Inside a patient the two
    sides vary independently, so pairs add nothing to the covariance beyond the
    patient means. One pass over one row per patient is enough. ``center`` is
    any value near the bulk of x and y; it keeps digits and changes nothing else.
    """
    means = join_patients(
        per_patient(
            left.where(F.col(x).isNotNull()),
            n=F.count(x),
            mean_x=F.avg(F.col(x) - center[0]),
            spread_x=F.var_pop(x),
        ),
        per_patient(
            right.where(F.col(y).isNotNull()),
            m=F.count(y),
            mean_y=F.avg(F.col(y) - center[1]),
            spread_y=F.var_pop(y),
        ),
    )
    pairs = F.col("n").cast("double") * F.col("m")
    dx, dy = F.col("mean_x"), F.col("mean_y")
    moments = means.agg(
        F.sum(pairs).alias("w"),
        F.sum(pairs * dx).alias("x"),
        F.sum(pairs * dy).alias("y"),
        F.sum(pairs * dx * dy).alias("xy"),
        F.sum(pairs * (F.col("spread_x") + dx * dx)).alias("xx"),
        F.sum(pairs * (F.col("spread_y") + dy * dy)).alias("yy"),
    )

    def about_mean(product: str, first: str, second: str) -> Column:
        return F.col(product) - F.col(first) * F.col(second) / F.col("w")

    spread = F.sqrt(about_mean("xx", "x", "x")) * F.sqrt(about_mean("yy", "y", "y"))
    return moments.select(
        (about_mean("xy", "x", "y") / F.nullif(spread, F.lit(0.0))).alias("corr")
    )
