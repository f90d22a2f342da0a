from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from conftest import rows_of
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from biotrace.functions import exprs as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def years_and_months(dob: date, today: date) -> tuple[int, int]:
    months = (today.year - dob.year) * 12 + today.month - dob.month - (today.day < dob.day)
    return months // 12, months % 12


@pytest.mark.parametrize(
    ("dob", "as_of", "years"),
    [
        ("2000-02-29", "2025-02-28", 24),
        ("2000-02-29", "2025-03-01", 25),
        ("2000-02-29", "2024-02-29", 24),
        ("1974-02-01", "2024-02-01", 50),
        ("1974-02-02", "2024-02-01", 49),
    ],
)
def test_age_years(spark, dob, as_of, years):
    assert one(spark, X.age_years(F.lit(dob).cast("date"), as_of)) == years


@settings(
    max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    st.lists(
        st.tuples(
            st.dates(date(1920, 1, 1), date(2010, 12, 31)),
            st.dates(date(2011, 1, 1), date(2040, 12, 31)),
        ),
        min_size=50,
        max_size=50,
    )
)
def test_age_is_the_calendar_rule(spark, pairs):
    df = spark.createDataFrame(pairs, "dob date, today date")
    found = df.select(
        "dob",
        "today",
        X.age_years("dob", F.col("today")),
        X.age_months("dob", F.col("today")) % 12,
    ).collect()
    assert all((r[2], r[3]) == years_and_months(r[0], r[1]) for r in found)


@pytest.mark.parametrize(("dob", "ok"), [("1994-02-01", True), ("1994-01-31", False)])
def test_age_at_most_ends_on_the_birthday(spark, dob, ok):
    assert one(spark, X.age_at_most(F.lit(dob).cast("date"), 30, "2024-02-01")) is ok


@pytest.mark.parametrize(
    ("value", "digits", "rounded"),
    [(78.78499999999999, 2, 78.79), (0.125, 2, 0.13), (-0.125, 2, -0.13), (2.4999, 0, 2.0), (2.0049999996, 2, 2.0), (1e20, 2, 1e20)],
)
def test_round_half_up(spark, value, digits, rounded):
    assert one(spark, X.round_half_up(F.lit(value), digits)) == rounded


def test_round_to_int_does_not_truncate(spark):
    assert one(spark, X.round_to_int(F.lit(2.7))) == 3


@pytest.mark.parametrize(("value", "quotient"), [(13, 1), (-13, -1), (11, 0)])
def test_whole_division(spark, value, quotient):
    assert one(spark, X.whole_division(F.lit(value), 12)) == quotient


@pytest.mark.parametrize(("value", "text"), [(140.0, "140"), (139.95, "139.95"), (0.0, "0")])
def test_number_text(spark, value, text):
    assert one(spark, X.number_text(F.lit(value))) == text


def test_hour_between_includes_the_last_hour(spark):
    times = [
        ("2024-01-01 17:59:59", False),
        ("2024-01-01 18:00:00", True),
        ("2024-01-01 20:59:59", True),
        ("2024-01-01 21:00:00", False),
    ]
    for ts, inside in times:
        assert one(spark, X.hour_between(F.lit(ts).cast("timestamp_ntz"), 18, 20)) is inside


def test_epoch_and_clock_do_not_depend_on_the_session_zone(spark):
    moment = datetime(2024, 7, 1, 23, 30, 0, 250000)
    df = spark.createDataFrame([(moment,)], "ts timestamp_ntz")
    picked = df.select(X.epoch_seconds("ts"), X.time_of_day("ts"), F.hour("ts"), F.to_date("ts"))
    want = ((moment - datetime(1970, 1, 1)) / timedelta(seconds=1), "23:30:00", 23, moment.date())
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert tuple(picked.first()) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize(
    ("food", "found"),
    [
        ("Fried Egg", True),
        ("eggs, bacon", True),
        ("Eggplant", False),
        ("veggie", False),
        ("egg-white", True),
        ("eggé", False),
        ("egg_salad", False),
        (None, None),
    ],
)
def test_word_match(spark, food, found):
    assert one(spark, X.word_match(F.lit(food).cast("string"), "egg", "eggs")) is found


@pytest.mark.parametrize(
    ("text", "title"),
    [
        ("sugar-free cheese/rose", "Sugar-Free Cheese/Rose"),
        ("o'neil BISQUE", "O'Neil Bisque"),
        ("7up rose", "7up Rose"),
        ("", ""),
        (None, None),
    ],
)
def test_title_case(spark, text, title):
    assert one(spark, X.title_case(F.lit(text).cast("string"))) == title


def test_last_word_character(spark):
    df = spark.createDataFrame([("Ruth",), ("Ruth!",), ("",), (None,)], "n string")
    assert rows_of(df.select(X.last_word_character("n"))) == [("h",), (None,), (None,), (None,)]


def test_join_text_takes_null_as_empty(spark):
    df = spark.createDataFrame([("A", None)], "a string, b string")
    assert df.select(X.join_text("a", F.lit(" "), "b")).first()[0] == "A "


def test_on_date_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame(
        [(datetime(2024, 1, 13),), (datetime(2024, 1, 13, 23, 59, 59),), (datetime(2024, 1, 14),)],
        "ts timestamp_ntz",
    ).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).where(X.on_date("ts", "2024-01-13"))
    assert df.count() == 2
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan
