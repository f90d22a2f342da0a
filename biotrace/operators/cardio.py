"""Questions about heart rate, heart-rate variability and electrodermal activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from biotrace.functions.exprs import (
    age_months,
    age_years,
    day_of,
    hrv_score,
    round_half_up,
    round_to_int,
)
from biotrace.plans.fanout import cross_correlation, join_patients, per_patient
from biotrace.plans.keys import all_at_max, top_one, with_key_in
from biotrace.schema import AsOf, Tables


def _hrv_per_patient(t: Tables) -> DataFrame:
    return per_patient(t.ibi, hrv=hrv_score())


# --- stress ------------------------------------------------------------------


def _stress_days(t: Tables, eda_above: float, hr_above: float, hrv_below: float) -> DataFrame:
    """Patient-days with all three signals on which any stress test is met."""
    day = F.to_date("datestamp").alias("day")
    beats = t.ibi.groupBy("patientid", day).agg(hrv_score().alias("hrv"))
    skin = t.eda.select("patientid", day, "max_eda")
    heart = t.hr.select("patientid", day, "max_hr")
    stressed = (
        (F.col("max_eda") > eda_above)
        | (F.col("max_hr") > hr_above)
        | (F.col("hrv") < hrv_below)
    )
    on = ["patientid", "day"]
    return beats.join(skin, on).join(heart, on).where(stressed)


def stress_days_top(
    t: Tables, eda_above: float = 40, hr_above: float = 100, hrv_below: float = 20
) -> DataFrame:
    """Patient or patients with the most stress days."""
    days = _stress_days(t, eda_above, hr_above, hrv_below).select("patientid", "day").distinct()
    counted = per_patient(days, stress_days=F.count("*"))
    return all_at_max(with_key_in(counted, t.demographics, "patientid"), "stress_days")


def stress_days(
    t: Tables, eda_above: float = 40, hr_above: float = 100, hrv_below: float = 2
) -> DataFrame:
    """Stress days of every patient who has any."""
    days = per_patient(_stress_days(t, eda_above, hr_above, hrv_below), no_of_days=F.count("*"))
    return t.demographics.join(days, "patientid").select(
        "patientid", "firstname", "lastname", "no_of_days"
    )


def eda_day_leader(t: Tables, true_date: bool = False) -> DataFrame:
    """Patient who most often had the highest EDA of a day of the month, or of a date.

    The rank-1 filter becomes a group limit on the map side, so only candidates
    of each day are shuffled although there are at most 31 days.
    """
    by_day = Window.partitionBy("day").orderBy(F.desc("max_eda"), "patientid")
    leaders = (
        t.eda.where(F.col("max_eda").isNotNull())
        .select("patientid", day_of("datestamp", true_date).alias("day"), "max_eda")
        .withColumn("place", F.row_number().over(by_day))
        .where(F.col("place") == 1)
    )
    return top_one(
        per_patient(leaders, number_days_highest=F.count("*")), "number_days_highest", "patientid"
    )


def stress_profile(t: Tables, hrv_below: float = 55, hr_above: float = 90) -> DataFrame:
    """Highest EDA, HRV and highest rate of patients with low HRV and a high rate."""
    profile = join_patients(
        per_patient(t.eda, max_eda=F.max("max_eda")),
        _hrv_per_patient(t).where(F.col("hrv") < hrv_below),
        per_patient(t.hr, max_hr=F.max("max_hr")).where(F.col("max_hr") > hr_above),
    )
    return with_key_in(profile, t.demographics, "patientid")


def least_healthy(t: Tables, hrv_below: float = 20, mean_hr_from: float = 100) -> DataFrame:
    """First patient by mean rate among those with low HRV and a high-rate day."""
    both = join_patients(
        per_patient(t.hr, hr_mean=F.avg("mean_hr"), peak=F.max("mean_hr")).where(
            F.col("peak") >= mean_hr_from
        ),
        _hrv_per_patient(t).where(F.col("hrv") < hrv_below),
    )
    return (
        with_key_in(both, t.demographics, "patientid")
        .select(
            "patientid",
            round_half_up("hr_mean").alias("hr_mean"),
            round_half_up("hrv").alias("hrv"),
        )
        .orderBy("hr_mean", "hrv", "patientid")
        .limit(1)
    )


def hr_out_low_hrv(
    t: Tables, low: float = 60, high: float = 100, hrv_below: float = 20
) -> DataFrame:
    """Patients with low HRV and a day whose mean rate is out of range."""
    odd_days = t.hr.where((F.col("mean_hr") <= low) | (F.col("mean_hr") >= high))
    low_hrv = _hrv_per_patient(t).where(F.col("hrv") < hrv_below).select("patientid")
    return with_key_in(
        with_key_in(low_hrv, odd_days, "patientid"), t.demographics, "patientid"
    )


def least_healthy_left(t: Tables, mean_hr_from: float = 100, hrv_below: float = 50) -> DataFrame:
    """Lowest HRV among patients with a high mean rate.

    The bound on the rate drops patients without one, so the outer join of the
    question is an inner join.
    """
    both = join_patients(
        _hrv_per_patient(t).where(F.col("hrv") < hrv_below),
        per_patient(t.hr, hr_mean=F.avg("mean_hr")).where(F.col("hr_mean") >= mean_hr_from),
    )
    return (
        both.select("patientid", "hr_mean", round_to_int("hrv").alias("hrv"))
        .orderBy("hrv", "hr_mean", "patientid")
        .limit(1)
    )


# --- electrodermal activity --------------------------------------------------


def eda_top(t: Tables) -> DataFrame:
    return top_one(t.eda.select("patientid", "max_eda"), "max_eda", "patientid")


def _with_age(df: DataFrame, as_of: AsOf) -> DataFrame:
    return df.select(
        "patientid",
        "firstname",
        "lastname",
        "gender",
        age_years("dob", as_of).alias("age_years"),
        (age_months("dob", as_of) % 12).alias("age_months"),
    )


def eda_max_patient(t: Tables, as_of: AsOf = None) -> DataFrame:
    """Every patient-day that reaches the highest EDA of all, with the person."""
    peak = all_at_max(t.eda.select("patientid", "max_eda"), "max_eda")
    return _with_age(t.demographics.join(peak, "patientid"), as_of)


def eda_high_patients(t: Tables, above: float = 40, as_of: AsOf = None) -> DataFrame:
    high = t.eda.where(F.col("max_eda") > above)
    return _with_age(with_key_in(t.demographics, high, "patientid"), as_of).orderBy("patientid")


def eda_without_min(t: Tables) -> DataFrame:
    """EDA without its daily minimum; no error when it is already gone."""
    return t.eda.drop("min_eda")


def eda_between_rows(t: Tables, low: float = 40, high: float = 50) -> DataFrame:
    """Highest daily maximum inside the bounds, per patient."""
    return per_patient(t.eda.where(F.col("max_eda").between(low, high)), max_eda=F.max("max_eda"))


def eda_between_max(t: Tables, low: float = 40, high: float = 50) -> DataFrame:
    """Patients whose own maximum lies strictly inside the bounds."""
    return (
        per_patient(t.eda, max_eda=F.max("max_eda"))
        .where((F.col("max_eda") > low) & (F.col("max_eda") < high))
        .orderBy("max_eda")
    )


def eda_buckets(
    t: Tables, low: float = 0, high: float = 100, buckets: int = 5
) -> DataFrame:
    """Distinct patient maxima per bucket, with the values seen in it."""
    bucket = F.width_bucket(
        "max_eda", F.lit(float(low)), F.lit(float(high)), F.lit(buckets)
    )
    return (
        t.eda.select("patientid", "max_eda")
        .distinct()
        .groupBy(bucket.alias("category"))
        .agg(F.min("max_eda").alias("lo"), F.max("max_eda").alias("hi"), F.count("*").alias("n"))
        .orderBy("category")
    )


def eda_buckets_auto(t: Tables, buckets: int = 5) -> DataFrame:
    """Like ``eda_buckets`` between the lowest and highest value of the table.

    The bounds are scalar subqueries; the highest value falls in an extra bucket.
    """
    low = t.eda.select(F.min("max_eda")).scalar()
    high = t.eda.select(F.max("max_eda")).scalar()
    return (
        t.eda.select("patientid", "max_eda")
        .distinct()
        .select(F.width_bucket("max_eda", low, high, F.lit(buckets)).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("patients"))
        .orderBy("bucket")
    )


# --- heart-rate variability --------------------------------------------------


def hrv(t: Tables) -> DataFrame:
    return per_patient(t.ibi, hrv=round_half_up(hrv_score()))


def hrv_class(t: Tables, low: float = 20, high: float = 50) -> DataFrame:
    # Names of the classes.
    label = (
        F.when(F.col("hrv") < low, "Low HRV")
        .when(F.col("hrv") > high, "High HRV")
        .otherwise("Normal HRV")
    )
    return hrv(t).withColumn("hrv_class", label).orderBy("patientid")


def hrv_buckets(t: Tables, high: int = 100, buckets: int = 5) -> DataFrame:
    """Patients per bucket of the rounded HRV, with the values seen in it."""
    score = per_patient(t.ibi, hrv=round_to_int(hrv_score()))
    return (
        score.groupBy(
            F.width_bucket("hrv", F.lit(0), F.lit(high), F.lit(buckets)).alias("category")
        )
        .agg(F.min("hrv").alias("lo"), F.max("hrv").alias("hi"), F.count("*").alias("patients"))
    )


def hrv_category(t: Tables, high: float = 240, buckets: int = 4) -> DataFrame:
    return _hrv_per_patient(t).withColumn(
        "hrv_category", F.width_bucket("hrv", F.lit(0.0), F.lit(float(high)), F.lit(buckets))
    )


def ibi_datepart(t: Tables) -> DataFrame:
    """IBI with the date of each row, added only where it is missing."""
    return t.ibi.withColumns(
        {} if "datepart" in t.ibi.columns else {"datepart": F.to_date("datestamp")}
    )


def ibi_variance(t: Tables) -> DataFrame:
    return per_patient(t.ibi, variance=round_half_up(F.var_pop("mean_ibi_ms")))


def corr_eda_hr(t: Tables, digits: int | None = 2) -> DataFrame:
    """Correlation of mean EDA and mean rate over all pairs of a patient's days."""
    exact = cross_correlation(t.eda, "mean_eda", t.hr, "mean_hr", center=(10.0, 80.0))
    value = F.col("corr") if digits is None else round_half_up("corr", digits)
    return exact.select(value.alias("correlation"))


def corr_hrv_eda(t: Tables) -> DataFrame:
    """Correlation of HRV and highest EDA over patients."""
    both = join_patients(
        per_patient(t.ibi, hrv=round_half_up(hrv_score())),
        per_patient(t.eda, max_eda=F.max("max_eda")),
    )
    return both.agg(round_half_up(F.corr("hrv", "max_eda")).alias("corr_eda_hrv"))


# --- heart rate --------------------------------------------------------------


def hr_daily_high(t: Tables, true_date: bool = False) -> DataFrame:
    """Highest mean rate per patient and day of the month, or per date."""
    return t.hr.groupBy("patientid", day_of("datestamp", true_date).alias("day")).agg(
        round_half_up(F.max("mean_hr")).alias("high_hr")
    )


def hr_best_day(t: Tables) -> DataFrame:
    """Day or days on which each patient's mean rate was highest."""
    within = Window.partitionBy("patientid").orderBy(F.desc("mean_hr"))
    return (
        t.hr.where(F.col("mean_hr").isNotNull())
        .select("patientid", "mean_hr", F.to_date("datestamp").alias("highest_mean_hr_day"))
        .withColumn("place", F.rank().over(within))
        .where(F.col("place") == 1)
        .drop("place")
    )


def low_hr_patients(t: Tables, below: float = 60) -> DataFrame:
    """How many patients have a lowest rate under a level."""
    return t.hr.where(F.col("min_hr") < below).agg(
        F.countDistinct("patientid").alias("patients")
    )


def hr_age_gender(t: Tables, as_of: AsOf = None) -> DataFrame:
    mean = per_patient(t.hr, mean_hr=round_half_up(F.avg("mean_hr")))
    return t.demographics.join(mean, "patientid").select(
        "patientid", "mean_hr", age_years("dob", as_of).alias("age"), "gender"
    )


def hr_stddev(t: Tables) -> DataFrame:
    return t.hr.agg(round_half_up(F.stddev_samp("mean_hr")).alias("stddev"))


def tachycardia(t: Tables, above: float = 100) -> DataFrame:
    """Patients whose mean rate is high, with gender."""
    mean = per_patient(t.hr, mean_hr=F.avg("mean_hr")).where(F.col("mean_hr") > above)
    return t.demographics.join(mean, "patientid").select(
        "patientid", "gender", round_half_up("mean_hr").alias("mean_hr")
    )


def prediabetic_high_hr(
    t: Tables, low: float = 5.7, high: float = 6.4, above: float = 100
) -> DataFrame:
    """Prediabetic patients with a high maximum rate."""
    peak = per_patient(t.hr, hr=F.max("max_hr")).where(F.col("hr") > above)
    return (
        t.demographics.where(F.col("hba1c").between(low, high))
        .join(peak, "patientid")
        .select("patientid", round_half_up("hr").alias("hr"), "hba1c")
        .orderBy("patientid")
    )
