"""Questions about continuous glucose readings."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biotrace.functions.exprs import (
    age_months,
    age_years,
    day_of,
    epoch_seconds,
    exact_epoch_seconds,
    number_text,
    on_date,
    outside,
    round_half_up,
    seconds_between,
    sum_flag,
    whole_division,
)
from biotrace.plans.keys import ordered_by, top_one, with_key_in
from biotrace.plans.ranking import with_ranks, with_row_number
from biotrace.schema import AsOf, Tables

GLUCOSE = "glucose_value_mgdl"
READINGS_PER_HOUR = 12
MINUTES_PER_READING = 5


def _hours(rows: Column) -> Column:
    return round_half_up(rows / READINGS_PER_HOUR)


def egv_above(t: Tables, above: float = 155, event_type: str = "EGV") -> DataFrame:
    """Patients with a reading of the event type above a level."""
    wanted = t.eventtype.where(F.col("event_type") == event_type)
    # Pairs of patient and event are few, whatever the event of most readings.
    high = t.dexcom.where(F.col(GLUCOSE) > above).select("patientid", "eventid").distinct()
    return (
        high.join(wanted.select(F.col("id").alias("eventid")), "eventid", "left_semi")
        .select("patientid")
        .distinct()
        .orderBy("patientid")
    )


def null_glucose(t: Tables) -> DataFrame:
    """Patients who have a reading without a value."""
    missing = t.dexcom.where(F.col(GLUCOSE).isNull())
    return with_key_in(t.demographics, missing, "patientid").select("patientid", "gender", "hba1c")


def glucose_dense_rank(t: Tables, ordered: bool = True, true_date: bool = False) -> DataFrame:
    """Dense rank of each patient's highest value per day of the month, or per date."""
    highest = (
        t.dexcom.groupBy("patientid", day_of("datestamp", true_date).alias("day"))
        .agg(F.max(GLUCOSE).alias("max_glucose"))
        .select("patientid", "max_glucose")
    )
    ranked = with_ranks(highest, maxrank={"measure": "max_glucose", "dense": True})
    return ordered_by(
        ranked.select("patientid", "maxrank", "max_glucose"),
        ordered,
        "patientid",
        F.desc("max_glucose"),
    )


def glucose_rank(t: Tables) -> DataFrame:
    """Rank of patients by their highest value."""
    highest = t.dexcom.groupBy("patientid").agg(F.max(GLUCOSE).alias("max_glucose"))
    return (
        with_ranks(highest, glucose_rank={"measure": "max_glucose"})
        .select("patientid", "max_glucose", "glucose_rank")
        .orderBy("glucose_rank", "patientid")
    )


def glucose_rank_in_patient(t: Tables, ordered: bool = True) -> DataFrame:
    """Dense rank of each patient's days by the day's highest value."""
    # One row per patient-day is left when the window sorts a patient.
    daily = t.dexcom.groupBy("patientid", F.to_date("datestamp").alias("day")).agg(
        F.max(GLUCOSE).alias("max_glucose")
    )
    within = Window.partitionBy("patientid").orderBy(F.desc("max_glucose"))
    ranked = daily.where(F.col("max_glucose").isNotNull()).withColumn(
        "rnk", F.dense_rank().over(within)
    )
    return ordered_by(ranked, ordered, "patientid", "rnk", "day")


def _out_of_range(t: Tables, low: float, high: float) -> DataFrame:
    return (
        t.dexcom.where(outside(GLUCOSE, low, high))
        .groupBy("patientid")
        .agg(_hours(F.count("*")).alias("hours_out_of_range"))
    )


def hours_out_of_range(t: Tables, low: float = 55, high: float = 200) -> DataFrame:
    return _out_of_range(t, low, high).orderBy("patientid")


def out_of_range_top(t: Tables, low: float = 55, high: float = 200) -> DataFrame:
    """Patient who spent the longest time out of range."""
    return top_one(_out_of_range(t, low, high), "hours_out_of_range", "patientid")


def minutes_recorded(t: Tables) -> DataFrame:
    return t.dexcom.groupBy("patientid").agg(
        (F.count("*") * MINUTES_PER_READING).alias("minutes")
    )


def epoch_minutes(t: Tables) -> DataFrame:
    """Minutes since 1970 for every reading."""
    return t.dexcom.select(
        "patientid", "datestamp", (exact_epoch_seconds("datestamp") / 60).alias("epoch_minute")
    )


def min_glucose_on(t: Tables, day: str | date) -> DataFrame:
    """Lowest value of each patient on a date."""
    return (
        t.dexcom.where(on_date("datestamp", day))
        .groupBy("patientid")
        .agg(F.min(GLUCOSE).alias("min_glucose"))
        .select("min_glucose", F.col("patientid").alias("patient_id"))
    )


def glucose_summary(t: Tables, chunk_seconds: int = 3600) -> DataFrame:
    """Mean value per reading time and a running ``DayN`` label per patient.

    A patient is numbered hour by hour, 12 readings at a time at the usual rate.
    """
    per_time = (
        t.dexcom.where(F.col("datestamp").isNotNull())
        .groupBy("patientid", F.col("datestamp").alias("date"))
        .agg(F.avg(GLUCOSE).alias("avg_glucose"))
    )
    chunk = F.floor(epoch_seconds("date") / chunk_seconds)
    return with_row_number(per_time, "patientid", "date", chunk, "n").select(
        "patientid",
        "date",
        "avg_glucose",
        F.concat(F.lit("Day"), F.col("n").cast("string")).alias("patient_day"),
    )


def glucose_daily(t: Tables, ordered: bool = True) -> DataFrame:
    """Mean value per day and the number of the day since the patient's first."""
    daily = t.dexcom.groupBy("patientid", F.to_date("datestamp").alias("day")).agg(
        round_half_up(F.avg(GLUCOSE)).alias("avg_glucose")
    )
    first = F.min("day").over(Window.partitionBy("patientid"))
    numbered = daily.select(
        "day",
        "patientid",
        "avg_glucose",
        (F.datediff("day", first) + 1).alias("patient_day"),
    )
    return ordered_by(numbered, ordered, "patientid", "patient_day")


def hypo_patients(t: Tables, below: float = 70, as_of: AsOf = None) -> DataFrame:
    """Patients with a value below a level, with gender and age."""
    low = t.dexcom.where(F.col(GLUCOSE) < below)
    return (
        with_key_in(t.demographics, low, "patientid")
        .select(
            "patientid",
            "gender",
            age_years("dob", as_of).alias("age_years"),
            (age_months("dob", as_of) % 12).alias("age_months"),
        )
        .orderBy("patientid")
    )


def hypo_severe(t: Tables, below: float = 55, as_of: AsOf = None) -> DataFrame:
    low = t.dexcom.where(F.col(GLUCOSE) < below)
    return with_key_in(t.demographics, low, "patientid").select(
        "patientid", age_years("dob", as_of).alias("age"), "gender"
    )


def least_control(t: Tables, hypo: float = 70, hyper: float = 126) -> DataFrame:
    """Patient with the most values at or beyond either level."""
    incidents = (
        t.dexcom.where((F.col(GLUCOSE) <= hypo) | (F.col(GLUCOSE) >= hyper))
        .groupBy("patientid")
        .agg(F.count("*").alias("incidents"))
    )
    return top_one(incidents, "incidents", "patientid")


def incident_counts(t: Tables, hypo: float = 70, hyper: float = 126) -> DataFrame:
    """Hypo- and hyperglycemic values per patient in one pass."""
    return (
        t.dexcom.groupBy("patientid")
        .agg(
            sum_flag(F.col(GLUCOSE) <= hypo).alias("hypoglycemic_incidents"),
            sum_flag(F.col(GLUCOSE) >= hyper).alias("hyperglycemic_incidents"),
        )
        .orderBy("patientid")
    )


def hypo_counts(t: Tables, at_most: float = 70) -> DataFrame:
    return (
        t.dexcom.groupBy("patientid")
        .agg(sum_flag(F.col(GLUCOSE) <= at_most).alias("hypoglycemic_incidents"))
        .orderBy("patientid")
    )


def hypo_daily(t: Tables, below: float = 55, ordered: bool = True) -> DataFrame:
    """Values below a level per patient and day; days without one count 0."""
    counted = t.dexcom.groupBy("patientid", F.to_date("datestamp").alias("day")).agg(
        sum_flag(F.col(GLUCOSE) < below).alias("hypoglycemic_incidents")
    )
    return ordered_by(counted, ordered, "patientid", "day")


def hours_recorded_int(t: Tables) -> DataFrame:
    return (
        t.dexcom.groupBy("patientid")
        .agg(whole_division(F.count("*") * MINUTES_PER_READING, 60).alias("hours"))
        .orderBy("patientid")
    )


def hours_span(t: Tables) -> DataFrame:
    """Hours from the first to the last reading."""
    span = seconds_between(F.min("datestamp"), F.max("datestamp")).cast("double")
    return (
        t.dexcom.groupBy("patientid")
        .agg(round_half_up(span / 3600).alias("total_hours"))
        .orderBy("patientid")
    )


def readings_of(t: Tables, patientid: int) -> DataFrame:
    return t.dexcom.where(F.col("patientid") == patientid)


def below_range_top(t: Tables, below: float = 55) -> DataFrame:
    """Demographics of the patient with the most values below range."""
    longest = (
        t.dexcom.where(F.col(GLUCOSE) < below)
        .groupBy("patientid")
        .agg(F.count("*").alias("readings_below"))
    )
    return top_one(t.demographics.join(longest, "patientid"), "readings_below", "patientid")


def patient_string(t: Tables, as_of: AsOf = None) -> DataFrame:
    """First name, last name, age and highest value in one string."""
    highest = t.dexcom.groupBy("patientid").agg(F.max(GLUCOSE).alias("max_glucose"))
    age = F.concat(age_years("dob", as_of).cast("string"), F.lit(" years"))
    details = F.concat("firstname", F.lit(" "), "lastname", F.lit(" "), age)
    return (
        t.demographics.join(highest, "patientid")
        .groupBy(details.alias("details"))
        .agg(F.max("max_glucose").alias("max_glucose"))
        .select(
            F.concat("details", F.lit(" "), number_text("max_glucose")).alias("details_string")
        )
    )
