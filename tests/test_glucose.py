from __future__ import annotations

from datetime import date, datetime, timedelta

from conftest import rows_of

from biotrace.operators import glucose, overview

T0 = datetime(2024, 1, 1, 8)


def reading(patient, value, minutes=0, event=1):
    return (patient, T0 + timedelta(minutes=minutes), event, value)


def person(patient, **fields):
    base = {
        "firstname": "Ann",
        "lastname": "Lee",
        "gender": "FEMALE",
        "hba1c": 5.5,
        "dob": date(1980, 1, 1),
    }
    return (patient, *{**base, **fields}.values())


def test_incidents_count_bounds_and_skip_null(make_tables):
    t = make_tables(
        dexcom=[reading(1, v) for v in (70.0, 70.1, 126.0, None)] + [reading(2, None)]
    )
    assert rows_of(glucose.incident_counts(t)) == [(1, 1, 1), (2, 0, 0)]


def test_ranks_leave_out_patients_without_values(make_tables):
    t = make_tables(
        dexcom=[reading(1, 200.0), reading(2, 200.0), reading(3, 150.5), reading(4, None)]
    )
    assert rows_of(glucose.glucose_rank(t)) == [(1, 200.0, 1), (2, 200.0, 1), (3, 150.5, 3)]
    assert rows_of(glucose.glucose_dense_rank(t)) == [(1, 1, 200.0), (2, 1, 200.0), (3, 2, 150.5)]


def test_ranks_inside_one_bucket_and_below_zero(make_tables):
    values = [3.25, 3.75, -0.5, -1.5, 3.75, 400.0]
    t = make_tables(dexcom=[reading(i, v) for i, v in enumerate(values)])
    order = sorted(values, reverse=True)
    want = sorted((i, v, order.index(v) + 1) for i, v in enumerate(values))
    assert sorted(rows_of(glucose.glucose_rank(t))) == want


def test_top_one_breaks_a_tie_by_patient(make_tables):
    t = make_tables(dexcom=[reading(7, 50.0), reading(3, 210.0), reading(5, 100.0)])
    assert rows_of(glucose.out_of_range_top(t)) == [(3, 0.08)]
    assert rows_of(glucose.least_control(t)) == [(3, 1)]


def test_summary_numbers_reading_times_across_days(make_tables):
    readings = [reading(1, float(100 + i), 700 * i) for i in range(7)] + [reading(1, 300.0, 700)]
    t = make_tables(dexcom=readings + [(1, None, 1, 90.0)])
    rows = glucose.glucose_summary(t).orderBy("date").collect()
    assert [r.patient_day for r in rows] == [f"Day{i}" for i in range(1, 8)]
    assert rows[1].avg_glucose == (101 + 300) / 2


def test_daily_counts_days_from_the_first(make_tables):
    t = make_tables(dexcom=[reading(1, 100.0), reading(1, 110.0, 3 * 1440)])
    assert rows_of(glucose.glucose_daily(t), "patient_day", "avg_glucose") == [
        (1, 100.0),
        (4, 110.0),
    ]


def test_one_hot_patient_gets_the_same_numbers(make_tables):
    """A patient with nearly all rows is numbered and ranked like any other."""
    hot = [reading(1, 40 + (i * 37 % 300) / 4, 5 * i) for i in range(3000)]
    t = make_tables(dexcom=hot + [reading(2, 90.0)])
    for seconds in (1, 3600, 10**7):
        rows = glucose.glucose_summary(t, seconds).orderBy("patientid", "date").collect()
        assert [r.patient_day for r in rows] == [f"Day{i}" for i in range(1, 3001)] + ["Day1"]


def test_null_glucose_and_hypo_are_one_row_per_patient(make_tables):
    t = make_tables(
        demographics=[person(1), person(2)],
        dexcom=[reading(1, None), reading(1, None, 5), reading(2, 60.0), reading(2, 61.0, 5)],
    )
    assert rows_of(glucose.null_glucose(t)) == [(1, "FEMALE", 5.5)]
    assert rows_of(glucose.hypo_patients(t, as_of="2024-02-01")) == [(2, "FEMALE", 44, 1)]
    assert rows_of(glucose.hypo_severe(t, as_of="2024-02-01")) == []


def test_event_type_limits_the_readings(make_tables):
    t = make_tables(
        eventtype=[(1, "EGV", "x"), (2, "Alert", "y")],
        dexcom=[reading(1, 160.0), reading(1, 170.0), reading(2, 160.0, event=2)],
    )
    assert rows_of(glucose.egv_above(t)) == [(1,)]


def test_hours(make_tables):
    t = make_tables(dexcom=[reading(1, 40.0, 5 * i) for i in range(13)])
    assert rows_of(glucose.hours_out_of_range(t)) == [(1, 1.08)]
    assert rows_of(glucose.hours_recorded_int(t)) == [(1, 1)]
    assert rows_of(glucose.hours_span(t)) == [(1, 1.0)]
    assert rows_of(glucose.minutes_recorded(t)) == [(1, 65)]


def test_patient_string_skips_null_names(make_tables):
    t = make_tables(
        demographics=[person(1), person(2, lastname=None)],
        dexcom=[reading(1, 140.0), reading(2, 150.25)],
    )
    got = rows_of(glucose.patient_string(t, as_of="2024-02-01"))
    assert sorted(got, key=str) == [("Ann Lee 44 years 140",), (None,)]


def test_health_rank_counts_no_time_out_of_range_as_zero(make_tables):
    t = make_tables(
        dexcom=[reading(1, 100.0), reading(2, 40.0), reading(3, 90.0)],
        ibi=[(1, T0, 0.05, 800.0), (2, T0, 0.09, 800.0), (4, T0, 0.01, 800.0)],
    )
    assert rows_of(overview.health_rank(t)) == [
        (1, 30.0, 0.0, 2, 1, 3),
        (2, 54.0, 0.08, 1, 2, 3),
    ]


def test_below_range_top_is_empty_without_low_values(make_tables):
    t = make_tables(demographics=[person(1)], dexcom=[reading(1, 100.0)])
    assert rows_of(glucose.below_range_top(t)) == []
