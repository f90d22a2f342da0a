"""Questions about patients themselves: names, ages, HbA1c, sampling."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biotrace.functions.exprs import (
    age_at_most,
    age_months,
    age_years,
    as_of_date,
    count_where,
    join_text,
    last_word_character,
    round_half_up,
    round_to_int,
    sum_flag,
    whole_division,
)
from biotrace.schema import AsOf, Tables


def gender_pct(t: Tables) -> DataFrame:
    """Share of men and women, whole percent by truncation and exact."""
    rows = F.count("*")

    def whole(gender: str) -> Column:
        return whole_division(count_where(F.col("gender") == gender) * 100, rows)

    def exact(gender: str) -> Column:
        return round_half_up(count_where(F.col("gender") == gender) * 100 / rows)

    return t.demographics.agg(
        whole("MALE").alias("male"),
        whole("FEMALE").alias("female"),
        exact("MALE").alias("male_pct"),
        exact("FEMALE").alias("female_pct"),
    )


def prediabetic(t: Tables, low: float = 5.7, high: float = 6.4) -> DataFrame:
    return t.demographics.where(F.col("hba1c").between(low, high))


def name_prefix(t: Tables, prefix: str = "A") -> DataFrame:
    """How many patients share each first name that starts with ``prefix``."""
    return (
        t.demographics.where(F.col("firstname").startswith(prefix))
        .groupBy("firstname")
        .agg(F.count("*").alias("patients"))
    )


def _age_buckets(t: Tables, buckets: int, as_of: AsOf) -> DataFrame:
    age = age_years("dob", as_of).alias("age")
    return t.demographics.select(age).withColumn(
        "age_bucket", F.width_bucket("age", F.lit(0), F.lit(100), F.lit(buckets))
    )


def age_hist10(t: Tables, as_of: AsOf = None) -> DataFrame:
    """Patients per bucket of ten years between 0 and 100."""
    return (
        _age_buckets(t, 10, as_of)
        .groupBy("age_bucket")
        .agg(F.count("*").alias("patients"))
        .orderBy("age_bucket")
    )


def age_hist20(t: Tables, as_of: AsOf = None) -> DataFrame:
    """Patients per bucket of five years, with the ages seen in it."""
    return (
        _age_buckets(t, 20, as_of)
        .groupBy("age_bucket")
        .agg(F.min("age").alias("lo"), F.max("age").alias("hi"), F.count("*").alias("patients"))
        .orderBy("age_bucket")
    )


def age_decades(t: Tables, as_of: AsOf = None) -> DataFrame:
    age = age_years("dob", as_of)
    return t.demographics.agg(
        *[sum_flag(age.between(lo, lo + 9)).alias(f"{lo}_{lo + 9}") for lo in (30, 40, 50)]
    )


# Labels by the age that closes them; all others get the last one.
AGE_RANGES = {"20-30": 30, "30-40": 40, "40-50": 50, "50-60": 60, "60-70": 70}
OTHER_AGES = "71+"


def age_ranges(t: Tables, as_of: AsOf = None) -> DataFrame:
    """Patients per labelled range; a birthday belongs to the range it closes.

    Ages under 20 end up under the last label, as they match no range.
    """
    label = F.when(age_years("dob", as_of) < 20, OTHER_AGES)
    for name, oldest in AGE_RANGES.items():
        label = label.when(age_at_most("dob", oldest, as_of), name)
    return (
        t.demographics.groupBy(label.otherwise(OTHER_AGES).alias("age_range"))
        .agg(F.count("*").alias("patients"))
        .orderBy("age_range")
    )


def random_patients(
    t: Tables, count: int = 5, hba1c_below: float = 6.0, seed: int | None = None
) -> DataFrame:
    """A random sample of patients; with a seed the same one on every cluster."""
    draw = F.rand() if seed is None else F.md5(join_text(F.lit(f"{seed}:"), "patientid"))
    return (
        t.demographics.where(F.col("hba1c") < hba1c_below)
        .select("patientid", "hba1c")
        .orderBy(draw, "patientid")
        .limit(count)
    )


def last_letter(t: Tables, containing: str = "h") -> DataFrame:
    """Last letter of the last name where the first name contains a letter."""
    return t.demographics.where(F.col("firstname").contains(containing)).select(
        "firstname", F.right("lastname", F.lit(1)).alias("last_letter")
    )


def last_letter_regex(t: Tables, pattern: str = "h") -> DataFrame:
    """Last letter of the first name where the first name matches a pattern."""
    return t.demographics.where(F.col("firstname").rlike(pattern)).select(
        "firstname", last_word_character("firstname").alias("last_letter")
    )


def full_name_matching(t: Tables, pattern: str = "an") -> DataFrame:
    either = F.col("firstname").rlike(pattern) | F.col("lastname").rlike(pattern)
    return t.demographics.where(either).select(
        "patientid", join_text("firstname", F.lit(" "), "lastname").alias("full_name")
    )


def hba1c_by_gender(t: Tables) -> DataFrame:
    return t.demographics.groupBy("gender").agg(
        round_half_up(F.avg("hba1c")).alias("average_hba1c")
    )


def birthdays_month(t: Tables, as_of: AsOf = None) -> DataFrame:
    """How many patients have their birthday in the month of ``as_of``."""
    return t.demographics.where(F.month("dob") == F.month(as_of_date(as_of))).agg(
        F.count("*").alias("patients")
    )


def long_names(t: Tables, longer_than: int = 7) -> DataFrame:
    return t.demographics.where(F.length("firstname") > longer_than).agg(
        F.count("*").alias("patients")
    )


def age_of(t: Tables, patientid: int, as_of: AsOf = None) -> DataFrame:
    return t.demographics.where(F.col("patientid") == patientid).select(
        age_years("dob", as_of).alias("age")
    )


def mean_age_months(t: Tables, as_of: AsOf = None) -> DataFrame:
    """Mean age as an interval: months, and the same as years plus months."""
    mean = F.avg(age_months("dob", as_of))
    years = F.floor(mean / 12)
    return t.demographics.agg(
        mean.alias("mean_age_months"),
        years.alias("years"),
        (mean - years * 12).alias("months"),
    )


def mean_age(t: Tables, as_of: AsOf = None) -> DataFrame:
    return t.demographics.agg(
        round_to_int(F.avg(age_years("dob", as_of))).alias("average_age")
    )


def females_under(t: Tables, age: int = 50, as_of: str | date | None = None) -> DataFrame:
    young = age_years("dob", as_of) < age
    return t.demographics.where((F.col("gender") == "FEMALE") & young).select(
        "patientid", "gender"
    )
