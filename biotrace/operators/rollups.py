"""Roll-ups from raw sensor samples to one row per series and day.

Samples have the columns ``series, ts, seq, value``. A series is whatever was
recorded without a break in meaning, as one sensor of one patient.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biotrace.functions.exprs import epoch_seconds, seconds_between
from biotrace.plans.median import group_profile

_DAY = ["series", "day"]


def _with_day(raw: DataFrame) -> DataFrame:
    return raw.withColumn("day", F.to_date("ts"))


def daily_signal_rollup(raw: DataFrame, width: float | None = None) -> DataFrame:
    """Median, lowest, highest and mean value per series and day.

    The median is exact. It is located by buckets of about equally many values, or
    of a fixed ``width``.
    """
    return group_profile(_with_day(raw), _DAY, "value", width)


def approx_signal_rollup(raw: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """The same in a single shuffle, with a median of bounded rank error."""
    return (
        _with_day(raw)
        .groupBy(*_DAY)
        .agg(
            F.min("value").alias("min_value"),
            F.max("value").alias("max_value"),
            F.avg("value").alias("mean_value"),
            F.percentile_approx("value", 0.5, accuracy).alias("median_value"),
        )
    )


def daily_hr_rollup(raw: DataFrame) -> DataFrame:
    """Lowest, mean and highest heart rate per series and day."""
    return (
        _with_day(raw)
        .groupBy(*_DAY)
        .agg(
            F.min("value").alias("min_hr"),
            F.avg("value").alias("mean_hr"),
            F.max("value").alias("max_hr"),
        )
    )


def _slot(seconds: float) -> Column:
    return F.floor(epoch_seconds("ts") / seconds)


def gap_slots(raw: DataFrame, gap_seconds: float = 3600) -> DataFrame:
    """First and last time and number of samples per slot of the gap's length.

    Slot rows of several lots of samples merge into those of all: ``merged_slots``.
    """
    return (
        _with_day(raw)
        .groupBy(*_DAY, _slot(gap_seconds).alias("slot"))
        .agg(
            F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("samples")
        )
    )


def merged_slots(slots: DataFrame) -> DataFrame:
    return slots.groupBy(*_DAY, "slot").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("samples").alias("samples")
    )


def runs_of_slots(slots: DataFrame, gap_seconds: float = 3600) -> DataFrame:
    """Runs that no gap above ``gap_seconds`` interrupts, from the slots of that length."""
    ordered = Window.partitionBy(*_DAY).orderBy("slot")
    pause = seconds_between(F.lag("last").over(ordered), "first")
    return (
        slots.withColumn("opens", F.when(pause <= gap_seconds, 0).otherwise(1))
        .withColumn("run", F.sum("opens").over(ordered))
        .groupBy(*_DAY, "run")
        .agg(
            F.min("first").alias("run_start"),
            F.max("last").alias("run_end"),
            F.sum("samples").alias("samples"),
        )
    )


def ibi_runs(raw: DataFrame, gap_seconds: float = 3600) -> DataFrame:
    """Runs of samples within a day that no gap above ``gap_seconds`` interrupts.

    Samples shrink to first and last time per slot of the gap's length. Inside
    such a slot no gap can be longer than allowed, so runs can only break
    between slots, and a day has at most ``86400 / gap_seconds`` of them.
    """
    return runs_of_slots(gap_slots(raw, gap_seconds), gap_seconds)


def window_of_runs(runs: DataFrame, minutes: int = 30) -> DataFrame:
    """Start and end of the minutes kept per series and day.

    They open the earliest run that lasts at least that long.
    """
    length = F.make_dt_interval(mins=F.lit(minutes))
    return (
        runs.where(seconds_between("run_start", "run_end") >= minutes * 60)
        .groupBy(*_DAY)
        .agg(F.min("run_start").alias("kept_from"))
        .withColumn("kept_to", F.col("kept_from") + length)
    )


def kept_window(
    raw: DataFrame, gap_seconds: float = 3600, minutes: int = 30
) -> DataFrame:
    """The window of ``window_of_runs`` from samples."""
    return window_of_runs(ibi_runs(raw, gap_seconds), minutes)


def samples_in(raw: DataFrame, window: DataFrame, slot_seconds: float = 60) -> DataFrame:
    """Samples inside a window per series and day, both ends included, with their slot.

    The window is spread over its few slots and joined on series, day and slot: the
    samples of a hot day lie in many slots, and most find no partner.
    """
    first, last = (
        F.floor(epoch_seconds(c) / slot_seconds) for c in ("kept_from", "kept_to")
    )
    spread = window.withColumn("slot", F.explode(F.sequence(first, last)))
    return (
        _with_day(raw)
        .withColumn("slot", _slot(slot_seconds))
        .join(spread, [*_DAY, "slot"])
        .where(F.col("ts").between(F.col("kept_from"), F.col("kept_to")))
        .drop("kept_to")
    )


def kept_samples(
    raw: DataFrame, gap_seconds: float = 3600, minutes: int = 30, slot_seconds: float = 60
) -> DataFrame:
    """Samples inside the kept minutes, both ends included, with their slot."""
    return samples_in(raw, kept_window(raw, gap_seconds, minutes), slot_seconds)


def rmssd_daily(
    raw: DataFrame, gap_seconds: float = 3600, minutes: int = 30, slot_seconds: float = 60
) -> DataFrame:
    """Root mean square of successive differences over the kept minutes, and their mean."""
    return rmssd_of(kept_samples(raw, gap_seconds, minutes, slot_seconds))


def rmssd_of(kept: DataFrame) -> DataFrame:
    """The same from kept samples with their slot.

    Differences are taken inside short slots; a slot also hands on its first and
    last value, which give the difference across each border.
    """
    inside = Window.partitionBy(*_DAY, "slot").orderBy("ts", "seq", "value")
    step = F.col("value") - F.lag("value").over(inside)
    slots = (
        kept.select(
            *_DAY,
            "slot",
            "kept_from",
            "value",
            step.alias("step"),
            F.row_number().over(inside).alias("place"),
            F.lead(F.lit(1)).over(inside).isNull().alias("is_last"),
        )
        .groupBy(*_DAY, "slot")
        .agg(
            F.sum(F.col("step") * F.col("step")).alias("squares"),
            F.count("step").alias("steps"),
            F.sum("value").alias("total"),
            F.count("value").alias("values"),
            F.first("kept_from").alias("kept_from"),
            F.max(F.when(F.col("place") == 1, F.col("value"))).alias("first"),
            F.max(F.when(F.col("is_last"), F.col("value"))).alias("last"),
        )
    )
    across = F.col("first") - F.lag("last").over(Window.partitionBy(*_DAY).orderBy("slot"))
    return (
        slots.withColumn("across", across)
        .groupBy(*_DAY)
        .agg(
            F.sum(F.coalesce("squares", F.lit(0.0))).alias("squares"),
            F.sum("steps").alias("steps"),
            F.sum(F.col("across") * F.col("across")).alias("squares_across"),
            F.count("across").alias("steps_across"),
            (F.sum("total") / F.sum("values")).alias("mean_value"),
            F.first("kept_from").alias("kept_from"),
        )
        .select(
            *_DAY,
            (F.col("steps") + F.col("steps_across")).alias("steps"),
            F.sqrt(
                (F.col("squares") + F.coalesce("squares_across", F.lit(0.0)))
                / F.nullif(F.col("steps") + F.col("steps_across"), F.lit(0))
            ).alias("rmssd"),
            "mean_value",
            "kept_from",
        )
    )


# --- from raw samples of patients to the tables ------------------------------


def _as_series(samples: DataFrame) -> DataFrame:
    return samples.withColumnRenamed("patientid", "series")


def _daily_range(samples: DataFrame, name: str) -> DataFrame:
    return samples.groupBy("patientid", F.to_date("ts").alias("datestamp")).agg(
        F.min("value").alias(f"min_{name}"),
        F.avg("value").alias(f"mean_{name}"),
        F.max("value").alias(f"max_{name}"),
    )


def eda_from_raw(samples: DataFrame) -> DataFrame:
    """Table ``eda`` from skin samples (patientid, ts, seq, value)."""
    return _daily_range(samples, "eda")


def hr_from_raw(samples: DataFrame) -> DataFrame:
    """Table ``hr`` from heart-rate samples."""
    return _daily_range(samples, "hr")


def ibi_from_raw(samples: DataFrame, gap_seconds: float = 3600, minutes: int = 30) -> DataFrame:
    """Table ``ibi`` from beat intervals: one row for the kept minutes of a patient-day."""
    return rmssd_daily(_as_series(samples), gap_seconds, minutes).select(
        F.col("series").alias("patientid"),
        F.col("kept_from").alias("datestamp"),
        F.col("rmssd").alias("rmssd_ms"),
        F.col("mean_value").alias("mean_ibi_ms"),
    )


def bvp_from_raw(samples: DataFrame, width: float | None = None) -> DataFrame:
    """Lowest, median and highest blood volume pulse per patient and day."""
    return daily_signal_rollup(_as_series(samples), width).select(
        F.col("series").alias("patientid"),
        F.col("day").alias("datestamp"),
        F.col("min_value").alias("min_bvp"),
        F.col("median_value").alias("median_bvp"),
        F.col("max_value").alias("max_bvp"),
    )
