"""Questions about device events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biotrace.plans.fanout import per_patient
from biotrace.schema import Tables


def event_types(t: Tables) -> DataFrame:
    """Rows of the event dimension per type."""
    return t.eventtype.groupBy("event_type").agg(F.count("*").alias("event_count"))


def event_counts(t: Tables) -> DataFrame:
    """Readings per event subtype, unused ones included, with the first letter.

    The dimension is the preserved side of the outer join and cannot be
    broadcast, so readings are counted per event id before they meet it.
    """
    used = t.dexcom.groupBy("eventid").agg(F.count("eventid").alias("used"))
    return (
        t.eventtype.join(used, F.col("id") == F.col("eventid"), "left")
        .groupBy("event_subtype")
        .agg(F.sum(F.coalesce("used", F.lit(0))).alias("event_id_count"))
        .withColumn("firstletter", F.left("event_subtype", F.lit(1)))
    )


def patient_events(t: Tables) -> DataFrame:
    """Each patient with the kinds of events seen and the lowest heart rate."""
    kinds = (
        t.dexcom.select("patientid", "eventid")
        .distinct()
        .join(t.eventtype.withColumnRenamed("id", "eventid"), "eventid")
        .select("patientid", "event_subtype", "event_type")
        .distinct()
    )
    lowest = per_patient(t.hr, min_hr=F.min("min_hr"))
    return (
        kinds.join(t.demographics, "patientid")
        .join(lowest, "patientid", "left")
        .select(
            "patientid",
            "firstname",
            "lastname",
            "gender",
            "event_subtype",
            "event_type",
            "min_hr",
        )
        .orderBy("patientid")
    )


def exercise_hr(t: Tables, event_type: str = "Exercise") -> DataFrame:
    """Highest heart rate of patients with an event, per date of the event.

    The rate is the patient's highest of all days, not of the event date.
    """
    kinds = t.eventtype.where(F.col("event_type") == event_type)
    # Readings shrink to patient, event and day before they meet the dimension.
    days = t.dexcom.select("patientid", "eventid", F.to_date("datestamp").alias("event_date")).distinct()
    dates = (
        days.join(kinds, F.col("eventid") == F.col("id"))
        .select("patientid", "event_type", "event_date")
        .distinct()
    )
    return dates.join(per_patient(t.hr, max_hr=F.max("max_hr")), "patientid")


def event_id_details(t: Tables, eventid: int = 16) -> DataFrame:
    """Demographics and readings of patients with an event id."""
    return t.demographics.join(t.dexcom.where(F.col("eventid") == eventid), "patientid")
