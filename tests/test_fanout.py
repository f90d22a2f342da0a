"""Aggregate-before-join against the join of rows it replaces."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from biotrace.operators import cardio, overview

DAY0 = date(2024, 1, 1)


@pytest.fixture(scope="module")
def uneven(make_tables):
    """Patients with very different row counts, some missing from a table."""
    rng = random.Random(3)
    people, dexcom, eda, hr, ibi = [], [], [], [], []
    for p in range(12):
        people.append((p, f"F{p}", f"L{p}", "MALE", 5.4 + p / 10, date(1970, 1, 1 + p)))
        for i in range(0 if p == 1 else 3 * p + 2):
            at = datetime(2024, 1, 1) + timedelta(days=i % 5, hours=i)
            value = None if i % 7 == 3 else rng.uniform(40, 250)
            dexcom.append((p, at, 1 + i % 2, value))
        for i in range(0 if p == 2 else 1 + p % 5):
            mean = None if i == 2 else rng.uniform(1, 60)
            eda.append((p, DAY0 + timedelta(days=i), 0.5, mean, rng.uniform(10, 60)))
        for i in range(0 if p == 3 else 2 + p % 4):
            hr.append((p, DAY0 + timedelta(days=i), 50.0, rng.uniform(55, 120), rng.uniform(80, 150)))
        for i in range(0 if p == 4 else 1 + 2 * (p % 3)):
            at = datetime(2024, 1, 1, 3) + timedelta(days=i % 3, minutes=i)
            ibi.append((p, at, rng.uniform(0.01, 0.1), 700.0 + i % 2))
    return make_tables(demographics=people, dexcom=dexcom, eda=eda, hr=hr, ibi=ibi)


def close(found, wanted):
    assert len(found) == len(wanted)
    for got, want in zip(found, wanted, strict=True):
        assert [
            pytest.approx(v, rel=1e-9) if isinstance(v, float) else v for v in want
        ] == list(got)


def test_correlation(uneven):
    t = uneven
    naive = t.eda.join(t.hr, "patientid").agg(F.corr("mean_eda", "mean_hr"))
    close(rows_of(cardio.corr_eda_hr(t, digits=None)), rows_of(naive))


def test_correlation_without_spread_is_null(make_tables):
    t = make_tables(eda=[(1, DAY0, 0.0, 5.0, 9.0)], hr=[(1, DAY0, 50.0, 70.0, 90.0)])
    assert rows_of(cardio.corr_eda_hr(t)) == [(None,)]


@pytest.mark.parametrize("hrv_below", [1.0, 30.0, 33.0, 60.0])
def test_group_stress(uneven, hrv_below):
    t = uneven
    joined = (
        t.demographics.where("hba1c >= 5.7")
        .join(t.eda, "patientid")
        .join(t.ibi, "patientid")
        .join(t.hr, "patientid")
    )
    naive = joined.agg(
        F.countDistinct("patientid").alias("n"), (F.avg("rmssd_ms") * 600).alias("hrv")
    ).where(F.col("hrv") < hrv_below)
    found = overview.diabetic_stress(t, eda_above=1e9, hrv_below=hrv_below, hr_above=1e9)
    assert rows_of(found) == rows_of(naive, "n")


def test_overview(uneven):
    t = uneven
    x, e, h, i = t.dexcom.alias("x"), t.eda.alias("e"), t.hr.alias("h"), t.ibi.alias("i")
    naive = (
        t.demographics.alias("d")
        .join(x, F.expr("d.patientid = x.patientid"), "left")
        .join(e, F.expr("x.patientid = e.patientid"), "left")
        .join(h, F.expr("e.patientid = h.patientid"), "left")
        .join(i, F.expr("h.patientid = i.patientid"), "left")
        .groupBy("d.patientid", "x.eventid")
        .agg(
            F.avg("glucose_value_mgdl"),
            F.avg("mean_eda"),
            F.max("max_eda"),
            F.min("min_hr"),
            F.max("max_hr"),
            F.avg("mean_hr"),
            F.avg("mean_ibi_ms"),
            F.avg("rmssd_ms"),
        )
    )
    found = overview.patient_overview(t).drop("firstname", "lastname", "gender", "hba1c")
    close(rows_of(found), rows_of(naive))


def test_daily_overview(uneven):
    t = uneven
    x, e, h, i = t.dexcom.alias("x"), t.eda.alias("e"), t.hr.alias("h"), t.ibi.alias("i")
    naive = (
        t.demographics.alias("d")
        .join(x, F.expr("d.patientid = x.patientid"))
        .join(e, F.expr("x.patientid = e.patientid and date(x.datestamp) = e.datestamp"), "left")
        .join(i, F.expr("e.patientid = i.patientid and e.datestamp = date(i.datestamp)"), "left")
        .join(h, F.expr("i.patientid = h.patientid and date(i.datestamp) = h.datestamp"), "left")
        .groupBy("d.patientid", "x.eventid", "i.mean_ibi_ms")
        .agg(
            F.min("glucose_value_mgdl"),
            F.max("max_eda"),
            F.avg("mean_hr"),
            F.min("min_hr"),
            F.max("max_hr"),
            F.min("rmssd_ms"),
        )
    )
    found = overview.patient_overview_daily(t).drop("gender", "hba1c", "dob")
    close(rows_of(found), rows_of(naive))


def test_biomarkers_are_one_array(uneven):
    t = uneven
    naive = (
        t.dexcom.join(t.hr, "patientid")
        .join(t.eda, "patientid")
        .groupBy("patientid")
        .agg(F.min("glucose_value_mgdl"), F.avg("mean_hr"), F.max("max_eda"))
    )
    found = overview.biomarkers(t)
    assert found.schema["biomarkers"].dataType.simpleString() == "array<double>"
    flat = [(row.pid, *row.biomarkers) for row in found.collect()]
    close(sorted(flat), rows_of(naive) and sorted(tuple(r) for r in naive.collect()))


def test_least_healthy(uneven):
    t = uneven
    naive = (
        t.demographics.join(t.hr, "patientid")
        .join(t.ibi, "patientid")
        .groupBy("patientid")
        .agg(
            F.avg("mean_hr").alias("m"),
            (F.avg("rmssd_ms") * 600).alias("hrv"),
            F.max("mean_hr").alias("peak"),
        )
        .where("hrv < 60 and peak >= 100")
        .orderBy("m")
        .limit(1)
    )
    found = cardio.least_healthy(t, hrv_below=60)
    assert rows_of(found, "patientid") == rows_of(naive, "patientid") != []
