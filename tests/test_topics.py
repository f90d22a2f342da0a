"""Edge rows of the demographic, cardio, food and event jobs."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from biotrace.operators import cardio, demographics, events, nutrition, overview, series
from biotrace.plans.keys import with_hot_key_in

DAY0 = date(2024, 1, 1)
AS_OF = "2024-02-01"


def person(patient, first="Ann", last="Lee", gender="FEMALE", hba1c=5.5, dob=date(1980, 1, 1)):
    return (patient, first, last, gender, hba1c, dob)


def food(patient, at, name, calorie=100, protein=0, sugar=0, fiber=0):
    amounts = [None if v is None else Decimal(str(v)) for v in (calorie, protein, sugar, fiber)]
    return (patient, datetime.fromisoformat(at) if at else None, name, *amounts)


def test_gender_truncates(make_tables):
    t = make_tables(demographics=[person(1), person(2), person(3, gender="MALE")])
    assert rows_of(demographics.gender_pct(t)) == [(33, 66, 33.33, 66.67)]


def test_age_ranges_close_on_the_birthday(make_tables):
    born = ["1994-02-01", "1994-01-31", "2010-01-01", "1953-01-01", "1954-02-01", None]
    t = make_tables(
        demographics=[
            person(i, dob=date.fromisoformat(b) if b else None) for i, b in enumerate(born)
        ]
    )
    assert rows_of(demographics.age_ranges(t, AS_OF)) == [
        ("20-30", 1),
        ("30-40", 1),
        ("60-70", 1),
        ("71+", 3),
    ]


def test_age_buckets_at_the_bounds(make_tables):
    t = make_tables(
        demographics=[
            person(1, dob=date(2024, 1, 1)),
            person(2, dob=date(1974, 2, 1)),
            person(3, dob=date(1924, 2, 1)),
        ]
    )
    assert rows_of(demographics.age_hist10(t, AS_OF)) == [(1, 1), (11, 1), (6, 1)]
    assert rows_of(demographics.age_hist20(t, AS_OF)) == [
        (1, 0, 0, 1),
        (11, 50, 50, 1),
        (21, 100, 100, 1),
    ]


def test_random_patients_repeat_with_a_seed(make_tables):
    t = make_tables(demographics=[person(i) for i in range(40)] + [person(99, hba1c=6.2)])
    first = rows_of(demographics.random_patients(t, seed=1))
    assert first == rows_of(demographics.random_patients(t, seed=1))
    assert first != rows_of(demographics.random_patients(t, seed=2))
    assert len(rows_of(demographics.random_patients(t))) == 5
    assert (99, 6.2) not in first


def test_names(make_tables):
    t = make_tables(
        demographics=[person(1, "Ruth", "Cobb"), person(2, None, "Zhang"), person(3, "H.", "An")]
    )
    assert rows_of(demographics.last_letter(t)) == [("Ruth", "b")]
    assert rows_of(demographics.last_letter_regex(t)) == [("Ruth", "h")]
    assert rows_of(demographics.full_name_matching(t)) == [(2, " Zhang")]


def test_mean_age(make_tables):
    t = make_tables(
        demographics=[person(1, dob=date(1984, 2, 1)), person(2, dob=date(1983, 1, 1))]
    )
    assert rows_of(demographics.mean_age_months(t, AS_OF)) == [(486.5, 40, 6.5)]
    assert rows_of(demographics.mean_age(t, AS_OF)) == [(41,)]


def test_eda_ties_and_bounds(make_tables):
    t = make_tables(
        demographics=[person(1), person(2), person(3)],
        eda=[
            (1, DAY0, 0.0, 1.0, 50.0),
            (2, DAY0, 0.0, 1.0, 50.0),
            (3, DAY0, 0.0, 1.0, 40.0),
            (9, DAY0, 0.0, 1.0, None),
        ],
    )
    assert rows_of(cardio.eda_top(t)) == [(1, 50.0)]
    assert rows_of(cardio.eda_max_patient(t, AS_OF), "patientid") == [(1,), (2,)]
    assert rows_of(cardio.eda_between_rows(t)) == [(1, 50.0), (2, 50.0), (3, 40.0)]
    assert rows_of(cardio.eda_between_max(t)) == []
    assert rows_of(cardio.eda_buckets(t, 40, 50, 5)) == [
        (1, 40.0, 40.0, 1),
        (6, 50.0, 50.0, 2),
        (None, None, None, 1),
    ]
    assert rows_of(cardio.eda_buckets_auto(t)) == [(1, 1), (6, 2), (None, 1)]


def test_equal_bounds_give_no_bucket(make_tables):
    t = make_tables(eda=[(1, DAY0, 0.0, 1.0, 50.0)])
    assert rows_of(cardio.eda_buckets_auto(t)) == [(None, 1)]


def test_best_day_keeps_ties(make_tables):
    second = date(2024, 1, 2)
    t = make_tables(
        hr=[(1, DAY0, 50.0, 80.0, 90.0), (1, second, 50.0, 80.0, 99.0), (2, DAY0, 50.0, None, 90.0)]
    )
    assert rows_of(cardio.hr_best_day(t)) == [(1, 80.0, DAY0), (1, 80.0, second)]


def test_stress_needs_all_signals_of_the_day(make_tables):
    t = make_tables(
        demographics=[person(1), person(2)],
        eda=[(1, DAY0, 0.0, 1.0, 41.0), (2, DAY0, 0.0, 1.0, 41.0)],
        hr=[(1, DAY0, 50.0, 80.0, 90.0)],
        ibi=[(p, datetime(2024, 1, 1, h), 0.1, 800.0) for p in (1, 2) for h in (1, 2)],
    )
    assert rows_of(cardio.stress_days(t)) == [(1, "Ann", "Lee", 1)]
    assert rows_of(cardio.stress_days_top(t)) == [(1, 1)]


def test_column_changes_do_nothing_twice(make_tables):
    t = make_tables()
    once = cardio.eda_without_min(t)
    assert once.columns == ["patientid", "datestamp", "mean_eda", "max_eda"]
    assert cardio.eda_without_min(make_tables().__class__(eda=once)).columns == once.columns
    dated = cardio.ibi_datepart(t)
    assert dated.columns[-1] == "datepart"
    assert cardio.ibi_datepart(t.__class__(ibi=dated)).columns == dated.columns


def test_draws_surround_the_mean_and_repeat(make_tables):
    t = make_tables(hr=[(p, DAY0, 50.0, 80.0, 90.0) for p in range(400)])
    draws = series.hr_draws(t)
    assert draws.count() == 4000
    stats = draws.agg(F.avg("hr_dist"), F.stddev("hr_dist"), F.max("draw")).first()
    assert stats[0] == pytest.approx(80, abs=0.4)
    assert stats[1] == pytest.approx(5, abs=0.3)
    assert stats[2] == 10
    assert rows_of(draws) == rows_of(series.hr_draws(t))


def test_series_spans_blocks(spark):
    df = spark.createDataFrame([(3,), (250,)], "k int")
    got = series.column_series(df, "k", block=100).orderBy("n").collect()
    assert [r.n for r in got] == list(range(3, 251))
    assert series.column_series(df.limit(0), "k").count() == 0
    assert [r.n for r in series.integer_series(spark).collect()] == list(range(1, 16))


def test_dinner_and_lunch_bounds(make_tables):
    t = make_tables(
        demographics=[person(1), person(2)],
        foodlog=[
            food(1, "2024-01-24 20:59:00", "rice", 300),
            food(1, "2024-01-24 21:00:00", "rice", 900),
            food(2, "2024-01-24 18:00:00", "rice", 200),
            food(2, "2024-01-24 19:00:00", "rice", 100),
            food(2, "2024-01-24 14:00:00", "soup", 50),
            food(2, "2024-01-24 14:00:01", "soup", 70),
        ],
    )
    assert rows_of(nutrition.dinner_top(t)) == [(1, "Ann", "Lee", Decimal("300.00"))]
    assert rows_of(nutrition.dinner_top_hour(t)) == [(1, "Ann", "Lee", Decimal("300.00"))]
    assert rows_of(nutrition.lunch_calories(t, "2024-01-24")) == [(2, Decimal("50.00"))]


def test_calorie_split(make_tables):
    t = make_tables(
        foodlog=[
            food(14, "2024-01-01 14:59:59", "a", 100),
            food(14, "2024-01-02 15:00:00", "b", 200),
            food(2, "2024-01-02 15:00:00", "b", 10),
        ]
    )
    assert [tuple(map(float, r)) for r in rows_of(nutrition.calorie_split(t))] == [(33.33, 66.67)]
    assert rows_of(nutrition.calorie_split(t, 3)) == []
    everyone = {r.patientid: (r.before, r.after) for r in nutrition.calorie_split(t, None).collect()}
    assert everyone[2] == (None, 100)


def test_words(make_tables):
    t = make_tables(
        foodlog=[
            food(1, "2024-01-01 08:00:00", "Fried Egg"),
            food(1, "2024-01-01 09:00:00", "Eggplant"),
            food(1, "2024-01-01 11:59:00", "BANANA bread"),
            food(2, "2024-01-01 12:00:00", "banana"),
            food(3, "2024-01-01 08:00:00", "Egg"),
            food(3, "2024-01-02 08:00:00", "sugar-free cheese"),
        ]
    )
    assert rows_of(nutrition.food_with_word(t), "logged_food") == [("Egg",), ("Fried Egg",)]
    assert rows_of(nutrition.food_named(t)) == [(3, DAY0, "08:00:00", "Egg")]
    assert rows_of(nutrition.breakfast_patients(t)) == [(1,)]
    assert rows_of(nutrition.title_foods(t)) == [("Sugar-Free Cheese",)]


def test_most_common_time(make_tables):
    late, early = datetime(2024, 1, 2), datetime(2024, 1, 1)
    t = make_tables(
        foodlog=[food(1, str(at), "spinach pie") for at in (late, early, late, early)]
        + [food(1, None, "spinach") for _ in range(3)]
    )
    assert rows_of(nutrition.word_mode(t)) == [(early,)]
    assert rows_of(nutrition.word_mode(t, "kale")) == [(None,)]
    assert rows_of(nutrition.word_time(t, "kale")) == []


def test_fiber_share_rounds_exactly(make_tables):
    t = make_tables(
        foodlog=[
            food(1, "2024-01-01 08:00:00", "a", fiber=3),
            food(1, "2024-01-01 09:00:00", "a", fiber=3.25),
            food(1, "2024-01-01 09:00:00", "a", fiber=None),
        ]
    )
    assert float(nutrition.fiber_share(t).first().fibre) == 0.13


def test_food_at_readings(make_tables):
    t = make_tables(
        dexcom=[
            (1, datetime(2024, 1, 1, 8), 1, 100.0),
            (1, datetime(2024, 1, 1, 9), 1, 180.0),
            (1, datetime(2024, 1, 1, 10), 1, 180.0),
            (2, datetime(2024, 1, 1, 8), 1, None),
        ],
        foodlog=[
            food(1, "2024-01-01 08:00:00", "toast"),
            food(1, "2024-01-01 09:00:00", "cake"),
            food(1, "2024-01-01 10:05:00", "pie"),
            food(2, "2024-01-01 08:00:00", "tea"),
        ],
    )
    assert rows_of(nutrition.food_at_reading(t)) == [(1, "cake"), (1, "toast"), (2, "tea")]
    assert rows_of(nutrition.food_at_peak(t)) == [(1, "cake")]
    assert rows_of(nutrition.food_at_peak(t, minutes=60)) == [(1, "cake"), (1, "pie")]


def test_youngest(make_tables):
    t = make_tables(
        demographics=[person(1), person(2, dob=date(2000, 2, 29)), person(3, dob=date(2000, 2, 29))],
        foodlog=[food(p, "2024-01-01 08:00:00", f"f{p % 2}") for p in (1, 2, 3, 3)],
    )
    assert rows_of(nutrition.youngest_foods(t, "2024-02-29")) == [("f0", 24, 0), ("f1", 24, 0)]


def test_events_without_readings_stay(make_tables):
    t = make_tables(
        eventtype=[(1, "EGV", "Estimated"), (2, "EGV", "Estimated"), (6, "Carbs", "Snack")],
        dexcom=[(1, datetime(2024, 1, 1), 1, 1.0), (1, datetime(2024, 1, 1), 2, 1.0)],
        demographics=[person(1)],
    )
    assert rows_of(events.event_counts(t)) == [("Estimated", 2, "E"), ("Snack", 0, "S")]
    assert rows_of(events.event_types(t)) == [("Carbs", 1), ("EGV", 2)]
    assert rows_of(events.patient_events(t)) == [
        (1, "Ann", "Lee", "FEMALE", "Estimated", "EGV", None)
    ]


def test_birthday_week_uses_iso_weeks(make_tables):
    t = make_tables(
        demographics=[person(1, dob=date(1971, 1, 1)), person(2, dob=date(1980, 6, 1))],
        dexcom=[(1, datetime(2021, 1, 1), 1, 1.0), (2, datetime(2021, 1, 1), 1, 1.0)],
        ibi=[(1, datetime(2021, 1, 2), 0.1, 800.0)],
    )
    assert rows_of(overview.birthday_week(t)) == [(1, 53, 53)]


def test_foods_of_event_with_odd_rows(make_tables):
    at = datetime(2024, 1, 1, 12)
    eaten = [(1, "Egg"), (1, "Egg"), (1, None), (2, "Rice"), (3, "Pear"), (None, "Fig"), (4, "Nut")]
    egv = (1, "EGV", "Estimated Glucose Value")
    t = make_tables(
        eventtype=[egv, egv, (2, "Exercise", "Walk")],
        dexcom=[(p, at, e, 100.0) for p, e in [(1, 1), (1, 1), (2, 2), (None, 1), (3, None)]],
        foodlog=[food(patient, "2024-01-01 12:00", name) for patient, name in eaten],
    )
    assert rows_of(nutrition.foods_of_event(t)) == [("Egg",), (None,)]
    assert rows_of(nutrition.foods_of_event(t, "Walk")) == [("Rice",)]
    assert rows_of(nutrition.foods_of_event(t, "Low")) == []


def test_rows_of_a_hot_key_are_kept(spark):
    key = F.when(F.col("id") % 4 > 0, 7).otherwise(F.col("id")).alias("key")
    rows = spark.range(4000).select(key, F.col("id").alias("value"))
    keys = spark.createDataFrame([(7,), (7,), (8,), (None,)], "key long")
    found = with_hot_key_in(rows, keys, "key", "value")
    assert found.columns == ["key", "value"]
    assert rows_of(found) == rows_of(rows.where("key IN (7, 8)"))
