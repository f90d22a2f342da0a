"""Views over several signals of a patient at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biotrace.functions.exprs import count_where, hrv_score, outside, round_half_up
from biotrace.plans.fanout import join_patients, per_patient, weighted_mean
from biotrace.plans.keys import with_key_in
from biotrace.plans.ranking import with_ranks
from biotrace.schema import PATIENT_BIOMETRICS, Tables

GLUCOSE = "glucose_value_mgdl"


def patient_biometrics(t: Tables) -> DataFrame:
    """Child table of demographics: all its columns plus two markers."""
    return join_patients(
        t.demographics,
        per_patient(t.eda, max_eda=F.max("max_eda")),
        per_patient(t.hr, mean_hr=F.avg("mean_hr")),
        how="left",
    ).select(*PATIENT_BIOMETRICS.names)


def patient_overview(t: Tables) -> DataFrame:
    """Demographics with mean markers, one row per patient and event id.

    In the chain of outer joins each table hangs on the one before it. Without
    EDA there is no heart rate and without heart rate no IBI, which is why the
    last two tables are joined first.
    """
    heart = per_patient(
        t.hr, minhr=F.min("min_hr"), maxhr=F.max("max_hr"), meanhr=F.avg("mean_hr")
    ).join(
        per_patient(t.ibi, meanibi=F.avg("mean_ibi_ms"), rmssd_avg=F.avg("rmssd_ms")),
        "patientid",
        "left",
    )
    markers = per_patient(t.eda, avg_eda=F.avg("mean_eda"), maxeda=F.max("max_eda")).join(
        heart, "patientid", "left"
    )
    readings = (
        t.dexcom.groupBy("patientid", "eventid")
        .agg(F.avg(GLUCOSE).alias("avg_glucose"))
        .join(markers, "patientid", "left")
    )
    return t.demographics.join(readings, "patientid", "left").select(
        "patientid",
        "firstname",
        "lastname",
        "gender",
        "hba1c",
        "eventid",
        "avg_glucose",
        "avg_eda",
        "maxeda",
        "minhr",
        "maxhr",
        "meanhr",
        "meanibi",
        "rmssd_avg",
    )


def patient_overview_daily(t: Tables) -> DataFrame:
    """Markers aligned by day, one row per patient, event id and mean IBI.

    Every table is first reduced to what a patient-day contributes, with the
    number of rows it stands for. The mean rate is weighted by these numbers.
    """
    on = ["patientid", "day"]
    readings = t.dexcom.groupBy("patientid", F.to_date("datestamp").alias("day"), "eventid").agg(
        F.count("*").alias("reading_rows"), F.min(GLUCOSE).alias("min_glucose")
    )
    skin = t.eda.groupBy("patientid", F.to_date("datestamp").alias("day")).agg(
        F.count("*").alias("eda_rows"), F.max("max_eda").alias("max_eda")
    )
    beats = t.ibi.groupBy(
        "patientid", F.to_date("datestamp").alias("day"), F.col("mean_ibi_ms").alias("mean_ibi")
    ).agg(F.count("*").alias("ibi_rows"), F.min("rmssd_ms").alias("min_rmssd"))
    heart = t.hr.groupBy("patientid", F.to_date("datestamp").alias("day")).agg(
        F.sum("mean_hr").alias("hr_sum"),
        F.count("mean_hr").alias("hr_rows"),
        F.min("min_hr").alias("min_hr"),
        F.max("max_hr").alias("max_hr"),
    )
    aligned = readings.join(
        skin.join(beats.join(heart, on, "left"), on, "left"), on, "left"
    ).withColumn("weight", F.col("reading_rows") * F.col("eda_rows") * F.col("ibi_rows"))
    markers = aligned.groupBy("patientid", "eventid", "mean_ibi").agg(
        F.min("min_glucose").alias("min_glucose"),
        F.max("max_eda").alias("max_eda"),
        weighted_mean(F.col("hr_sum"), F.col("hr_rows"), F.col("weight")).alias("avg_hr"),
        F.min("min_hr").alias("min_hr"),
        F.max("max_hr").alias("max_hr"),
        F.min("min_rmssd").alias("min_rmssd"),
    )
    people = t.demographics.select("patientid", "gender", "hba1c", "dob")
    return people.join(markers, "patientid").withColumnRenamed("patientid", "pid")


def biomarkers(t: Tables) -> DataFrame:
    """Array of lowest glucose, mean rate and highest EDA for every patient."""
    markers = join_patients(
        per_patient(t.dexcom, low=F.min(GLUCOSE)),
        per_patient(t.hr, mean=F.avg("mean_hr")),
        per_patient(t.eda, high=F.max("max_eda")),
    )
    return markers.select(
        F.col("patientid").alias("pid"), F.array("low", "mean", "high").alias("biomarkers")
    )


def _stress_by_patient(t: Tables, hba1c_from: float) -> DataFrame:
    """Per-patient sums and row counts of (pre)diabetic patients with all signals."""
    joined = join_patients(
        per_patient(t.eda, eda_rows=F.count("*"), max_eda=F.max("max_eda")),
        per_patient(t.ibi, rmssd_sum=F.sum("rmssd_ms"), rmssd_rows=F.count("rmssd_ms")),
        per_patient(t.hr, hr_rows=F.count("*"), max_hr=F.max("max_hr")),
    )
    diabetic = t.demographics.where(F.col("hba1c") >= hba1c_from)
    return with_key_in(joined, diabetic, "patientid")


def diabetic_stress_measures(t: Tables, hba1c_from: float = 5.7) -> DataFrame:
    """The (pre)diabetic patients as one group: size, highest EDA, HRV and highest rate.

    The HRV is the one of the full join, in which a beat counts once per EDA and HR row.
    """
    repeats = F.col("eda_rows") * F.col("hr_rows")
    return _stress_by_patient(t, hba1c_from).agg(
        F.count("*").alias("patients"),
        F.max("max_eda").alias("max_eda"),
        (weighted_mean(F.col("rmssd_sum"), F.col("rmssd_rows"), repeats) * 600).alias("hrv"),
        F.max("max_hr").alias("max_hr"),
    )


def diabetic_stress(
    t: Tables,
    hba1c_from: float = 5.7,
    eda_above: float = 40,
    hrv_below: float = 20,
    hr_above: float = 100,
) -> DataFrame:
    """Number of (pre)diabetic patients, if as one group they show stress.

    The test is on the whole group: the result has one row or none.
    """
    return diabetic_stress_measures(t, hba1c_from).where(
        (F.col("max_eda") > eda_above)
        | (F.col("hrv") < hrv_below)
        | (F.col("max_hr") > hr_above)
    ).select("patients")


def diabetic_stress_patients(
    t: Tables,
    hba1c_from: float = 5.7,
    eda_above: float = 40,
    hrv_below: float = 20,
    hr_above: float = 100,
) -> DataFrame:
    """Number of (pre)diabetic patients who each show stress themselves."""
    own_hrv = F.col("rmssd_sum") / F.nullif("rmssd_rows", F.lit(0)) * 600
    stressed = (
        (F.col("max_eda") > eda_above) | (own_hrv < hrv_below) | (F.col("max_hr") > hr_above)
    )
    return _stress_by_patient(t, hba1c_from).agg(count_where(stressed).alias("patients"))


def health_rank(t: Tables, low: float = 55, high: float = 200) -> DataFrame:
    """Patients by high HRV and little time out of range; lowest rank sum first."""
    both = join_patients(
        per_patient(t.ibi, hrv=round_half_up(hrv_score())),
        per_patient(
            t.dexcom, hours_out_of_range=round_half_up(count_where(outside(GLUCOSE, low, high)) / 12)
        ),
    )
    return (
        with_ranks(
            both,
            hrv_rank={"measure": "hrv"},
            range_rank={"measure": "hours_out_of_range", "descending": False},
        )
        .withColumn("rank_sum", F.col("hrv_rank") + F.col("range_rank"))
        .select(
            "patientid", "hrv", "hours_out_of_range", "hrv_rank", "range_rank", "rank_sum"
        )
        .orderBy("rank_sum", "patientid")
    )


def tachy_high_glucose(t: Tables, hr_above: float = 100, glucose_above: float = 200) -> DataFrame:
    """Patients with both a high heart rate and a high glucose value."""
    fast = t.hr.where(F.col("max_hr") > hr_above)
    sweet = t.dexcom.where(F.col(GLUCOSE) > glucose_above)
    people = with_key_in(t.demographics, fast, "patientid")
    return with_key_in(people, sweet, "patientid").select("patientid", "gender", "dob")


def birthday_week(t: Tables) -> DataFrame:
    """Patients with a reading in the calendar week of their birthday."""

    def weeks(df: DataFrame) -> DataFrame:
        return df.select("patientid", F.weekofyear("datestamp").alias("week")).distinct()

    seen = weeks(t.dexcom).union(weeks(t.ibi)).distinct()
    born = t.demographics.select("patientid", F.weekofyear("dob").alias("dob_week"))
    return (
        seen.join(born, "patientid")
        .where(F.col("dob_week") == F.col("week"))
        .select("patientid", "dob_week", "week")
    )
