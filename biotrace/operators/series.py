"""Generated rows: number series and random draws around measured values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biotrace.functions.exprs import join_text
from biotrace.schema import Tables


def _uniform(key: Column, first: int) -> Column:
    """Number in (0, 1] from eight hex digits of a hash of the key."""
    digits = F.conv(F.substring(F.md5(key), first, 8), 16, 10)
    return (digits.cast("double") + 1) / float(2**32)


def hr_draws(t: Tables, draws: int = 10, spread: float = 5.0, seed: int = 7) -> DataFrame:
    """Normal draws around each mean rate, numbered ``1..draws`` per row.

    Draws are a function of the row key, so a recomputed task repeats them.
    """
    between = F.lit(":")
    key = join_text(F.lit(f"{seed}:"), "patientid", between, "datestamp", between, "draw")
    normal = F.sqrt(-2 * F.ln(_uniform(key, 1))) * F.cos(2 * F.pi() * _uniform(key, 9))
    return t.hr.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).select(
        "draw", F.round(F.col("mean_hr") + spread * normal, 1).alias("hr_dist")
    )


def column_series(
    df: DataFrame, column: str, name: str = "n", block: int = 100_000, tasks: int | None = None
) -> DataFrame:
    """Every whole number from the lowest to the highest value of a column.

    The span is cut into blocks, and the blocks spread over ``tasks`` tasks
    before they expand. A fixed number of tasks keeps adaptive execution from
    merging them for their small size.
    """
    tasks = tasks or df.sparkSession.sparkContext.defaultParallelism
    span = df.agg(
        F.min(column).cast("bigint").alias("lo"), F.max(column).cast("bigint").alias("hi")
    ).where(F.col("lo").isNotNull())
    starts = span.select("hi", F.explode(F.sequence("lo", "hi", F.lit(block))).alias("start"))
    return starts.repartition(tasks, "start").select(
        F.explode(F.sequence("start", F.least("hi", F.col("start") + block - 1))).alias(name)
    )


def integer_series(spark: SparkSession, first: int = 1, last: int = 15) -> DataFrame:
    """Whole numbers ``first..last``, both included."""
    return spark.range(first, last + 1).toDF("n")
