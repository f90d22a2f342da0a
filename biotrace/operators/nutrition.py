"""Questions about logged food."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biotrace.functions.exprs import (
    age_months,
    age_years,
    day_of,
    epoch_seconds,
    hour_between,
    matches_any_case,
    time_of_day,
    title_case,
    word_match,
)
from biotrace.plans.keys import ordered_by, top_one, with_hot_key_in, with_key_in
from biotrace.plans.membership import with_hit
from biotrace.plans.reuse import shareable
from biotrace.schema import AsOf, Tables

GLUCOSE = "glucose_value_mgdl"


def protein_patients(t: Tables, at_least: float = 20) -> DataFrame:
    """How many patients had a meal with enough protein."""
    return t.foodlog.where(F.col("protein") >= at_least).agg(
        F.countDistinct("patientid").alias("patients")
    )


def _named(t: Tables, totals: DataFrame) -> DataFrame:
    return t.demographics.select("patientid", "firstname", "lastname").join(totals, "patientid")


def dinner_top(t: Tables, first_hour: int = 18, last_hour: int = 20) -> DataFrame:
    """Patient with the most calories at dinner."""
    eaten = (
        t.foodlog.where(hour_between("datetime", first_hour, last_hour))
        .groupBy("patientid")
        .agg(F.sum("calorie").alias("total_calorie"))
    )
    return top_one(_named(t, eaten), "total_calorie", "patientid")


def dinner_top_hour(t: Tables, first_hour: int = 18, last_hour: int = 20) -> DataFrame:
    """Patient with the most calories in a single dinner hour."""
    best = (
        t.foodlog.where(hour_between("datetime", first_hour, last_hour))
        .groupBy("patientid", F.hour("datetime").alias("hour"))
        .agg(F.sum("calorie").alias("eaten"))
        .groupBy("patientid")
        .agg(F.max("eaten").alias("dinner"))
    )
    return top_one(_named(t, best), "dinner", "patientid")


def _consumed(t: Tables, wanted: Column) -> DataFrame:
    return t.foodlog.where(wanted).select(
        "patientid",
        F.to_date("datetime").alias("date_consumed"),
        time_of_day("datetime").alias("time_consumed"),
        "logged_food",
    )


def food_with_word(t: Tables, *words: str) -> DataFrame:
    """When food with one of the words in its name was eaten."""
    return _consumed(t, word_match("logged_food", *(words or ("egg", "eggs"))))


def food_named(t: Tables, *names: str) -> DataFrame:
    """When food with exactly one of the names was eaten."""
    return _consumed(t, F.col("logged_food").isin(*(names or ("Eggs", "Egg"))))


def calorie_split(t: Tables, patientid: int | None = 14, hour: int = 15) -> DataFrame:
    """Percent of calories before and from an hour on, for one patient or all."""
    log = t.foodlog if patientid is None else t.foodlog.where(F.col("patientid") == patientid)

    def percent(part: Column) -> Column:
        return F.round(F.sum(F.when(part, F.col("calorie"))) * 100 / F.sum("calorie"), 2)

    before = F.hour("datetime") < hour
    split = log.groupBy("patientid").agg(
        percent(before).alias("before"), percent(~before).alias("after")
    )
    return split if patientid is None else split.select("before", "after")


def youngest_foods(t: Tables, as_of: AsOf = None) -> DataFrame:
    """Food of the youngest patient or patients, with the age."""
    born = t.demographics.select(F.max("dob")).scalar()
    youngest = t.demographics.where(F.col("dob") == born).select("patientid", "dob")
    return (
        t.foodlog.join(youngest, "patientid")
        .select("logged_food", "dob")
        .distinct()
        .select(
            "logged_food",
            age_years("dob", as_of).alias("age_years"),
            (age_months("dob", as_of) % 12).alias("age_months"),
        )
    )


def foods_of_patient(
    t: Tables, firstname: str = "Phill", lastname: str = "Collins"
) -> DataFrame:
    person = t.demographics.where(
        (F.col("firstname") == firstname) & (F.col("lastname") == lastname)
    )
    return t.foodlog.join(person, "patientid").select(
        "patientid", "firstname", "lastname", "logged_food"
    )


def word_time(t: Tables, word: str = "spinach") -> DataFrame:
    """Time at which food with the word was logged most often."""
    times = (
        t.foodlog.where(word_match("logged_food", word))
        .groupBy("datetime")
        .agg(F.count("*").alias("times"))
    )
    return top_one(times, "times", "datetime")


def word_mode(t: Tables, word: str = "spinach") -> DataFrame:
    """The same as a single value; the first in order wins and no food gives NULL.

    Counting per time first keeps the distinct times spread over the cluster.
    """
    dated = Tables(foodlog=t.foodlog.where(F.col("datetime").isNotNull()))
    return word_time(dated, word).agg(F.max("datetime").alias("mode"))


def fiber_share(t: Tables, allowance: int = 25, true_date: bool = False) -> DataFrame:
    """Mean fibre of a meal over the daily allowance, per day of the month, or per date."""
    mean = F.sum("dietary_fiber") / (F.count("dietary_fiber") * allowance)
    return t.foodlog.groupBy("patientid", day_of("datetime", true_date).alias("day")).agg(
        F.round(mean, 2).alias("fibre")
    )


def fiber_days(t: Tables, above: int = 25) -> DataFrame:
    """Dates on which a patient's meals hold more fibre than the allowance."""
    daily = t.foodlog.groupBy("patientid", F.to_date("datetime").alias("day"))
    return daily.agg(F.sum("dietary_fiber").alias("fibre")).where(F.col("fibre") > above)


def sugar_patients(t: Tables, above: float = 30) -> DataFrame:
    return t.foodlog.where(F.col("sugar") > above).select("patientid").distinct()


def _at(ts: str, minutes: int | None) -> Column:
    """The exact time, or the number of its slot of so many minutes."""
    slot = F.col(ts) if minutes is None else F.floor(epoch_seconds(ts) / (60 * minutes))
    return slot.alias("at")


def food_at_reading(t: Tables, minutes: int | None = None) -> DataFrame:
    """Food logged at the time of a reading, or in the same slot of ``minutes``."""
    log = t.foodlog.select("patientid", "logged_food", _at("datetime", minutes))
    readings = t.dexcom.select("patientid", _at("datestamp", minutes))
    return (
        with_key_in(log, readings, "patientid", "at").select("patientid", "logged_food").distinct()
    )


def food_at_peak(t: Tables, minutes: int | None = None) -> DataFrame:
    """Food logged at a time when the patient's glucose was at its own highest."""
    levels = shareable(
        t.dexcom.groupBy("patientid", _at("datestamp", minutes)).agg(
            F.max(GLUCOSE).alias("level")
        ),
        "patientid",
        "at",
        "level",
    )
    highest = levels.groupBy("patientid").agg(F.max("level").alias("level"))
    peaks = levels.join(highest, ["patientid", "level"], "left_semi")
    log = t.foodlog.select("patientid", "logged_food", _at("datetime", minutes))
    return with_key_in(log, peaks, "patientid", "at").select("patientid", "logged_food").distinct()


def title_foods(t: Tables, ending: str = "se") -> DataFrame:
    """Distinct foods with an ending, in title case."""
    return (
        t.foodlog.where(F.col("logged_food").endswith(ending))
        .select("logged_food")
        .distinct()
        .select(title_case("logged_food").alias("food"))
        .distinct()
    )


def breakfast_patients(
    t: Tables, pattern: str = "banana", first_hour: int = 8, last_hour: int = 11
) -> DataFrame:
    """How many patients had matching food at breakfast."""
    return t.foodlog.where(
        matches_any_case("logged_food", pattern) & hour_between("datetime", first_hour, last_hour)
    ).agg(F.countDistinct("patientid").alias("patients"))


def lunch_calories(
    t: Tables, day: str | date, start: str = "12:00:00", end: str = "14:00:00"
) -> DataFrame:
    """Calories per patient at lunch on a date, both ends included."""
    low, high = (F.lit(f"{day} {clock}").cast("timestamp_ntz") for clock in (start, end))
    return (
        t.foodlog.where(F.col("datetime").between(low, high))
        .groupBy("patientid")
        .agg(F.sum("calorie").alias("calories"))
    )


def foods_of_event(t: Tables, event_subtype: str = "Estimated Glucose Value") -> DataFrame:
    """Foods of patients who have an event of the subtype."""
    wanted = t.eventtype.where(F.col("event_subtype") == event_subtype)
    kinds = t.dexcom.select("patientid", "eventid").distinct()
    # Events are few, so their readings are spread by patient.
    wanted = wanted.select(F.col("id").alias("eventid"))
    patients = with_hot_key_in(kinds, wanted, "eventid", "patientid")
    # Pairs of patient and food may be nearly as many as meals, so making them distinct would
    # hold the whole log. Meals of other patients go where they are read; the others meet the
    # patients as they are, those of one patient spread by their food.
    eaten = with_hit(t.foodlog.select("patientid", "logged_food"), patients, "patientid")
    found = with_hot_key_in(eaten.where("hit"), patients, "patientid", "logged_food")
    return found.select("logged_food").distinct()


def daily_calories(t: Tables, ordered: bool = True) -> DataFrame:
    totals = t.foodlog.groupBy("patientid", F.to_date("datetime").alias("date")).agg(
        F.sum("calorie").alias("total_calories")
    )
    return ordered_by(totals, ordered, "patientid", "date")
