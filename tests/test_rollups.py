"""Roll-ups against plain Python over the same samples."""

from __future__ import annotations

import random
import statistics
from datetime import date, datetime, timedelta
from itertools import pairwise

import pytest
from conftest import rows_of

from biotrace.operators import rollups
from biotrace.schema import RAW_SIGNAL

T0 = datetime(2024, 1, 1)


def samples(seed: int, count: int, step: float):
    """Unsorted beats with pauses, ties in time and a few shared values."""
    rng = random.Random(seed)
    rows = []
    for series in ("a", "b"):
        at = T0 + timedelta(hours=rng.uniform(0, 3))
        for seq in range(count):
            pause = rng.random()
            at += timedelta(seconds=0 if pause < 0.05 else rng.uniform(0.1, step))
            if pause > 0.99:
                at += timedelta(seconds=rng.uniform(step, 40 * step))
            rows.append((series, at, seq, round(rng.uniform(-3, 9), 1)))
    rng.shuffle(rows)
    return rows


def by_day(rows):
    days: dict = {}
    for series, at, seq, value in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        days.setdefault((series, at.date()), []).append((at, seq, value))
    return days


def runs(day, gap):
    parts = [[day[0]]]
    for before, after in pairwise(day):
        if (after[0] - before[0]).total_seconds() > gap:
            parts.append([])
        parts[-1].append(after)
    return parts


@pytest.fixture(scope="module")
def raw(spark):
    rows = samples(5, 1500, 90.0)
    return rows, spark.createDataFrame(rows, RAW_SIGNAL)


@pytest.mark.parametrize("width", [0.05, 1.0, 1000.0])
def test_median_is_exact_for_any_bucket_width(raw, width):
    rows, df = raw
    want = [
        (*key, min(v), max(v), statistics.fmean(v), statistics.median(v))
        for key, day in by_day(rows).items()
        for v in [[value for _, _, value in day]]
    ]
    found = rollups.daily_signal_rollup(df, width)
    assert found.columns[2:] == ["min_value", "max_value", "mean_value", "median_value"]
    for got, expected in zip(rows_of(found), sorted(want, key=repr), strict=True):
        assert got[:4] == expected[:4]
        assert got[4:] == pytest.approx(expected[4:], rel=1e-12)


def test_rollup_keeps_days_without_values(spark):
    df = spark.createDataFrame(
        [("a", T0, 1, None), (None, T0, 1, 2.0), (None, T0, 2, 4.0), (None, T0, 3, None)],
        RAW_SIGNAL,
    )
    assert rows_of(rollups.daily_signal_rollup(df)) == [
        ("a", date(2024, 1, 1), None, None, None, None),
        (None, date(2024, 1, 1), 2.0, 4.0, 3.0, 3.0),
    ]


@pytest.mark.parametrize("gap", [20.0, 90.0, 600.0])
def test_runs(raw, gap):
    rows, df = raw
    want = [
        (*key, n, part[0][0], part[-1][0], len(part))
        for key, day in by_day(rows).items()
        for n, part in enumerate(runs(day, gap), 1)
    ]
    assert rows_of(rollups.ibi_runs(df, gap)) == sorted(want, key=repr)


@pytest.mark.parametrize(("gap", "minutes", "slot"), [(90.0, 30, 60.0), (600.0, 45, 7.0)])
def test_rmssd(raw, gap, minutes, slot):
    rows, df = raw
    want = []
    for key, day in by_day(rows).items():
        long = [
            part
            for part in runs(day, gap)
            if (part[-1][0] - part[0][0]).total_seconds() >= minutes * 60
        ]
        if long:
            end = long[0][0][0] + timedelta(minutes=minutes)
            kept = [value for at, _, value in day if long[0][0][0] <= at <= end]
            steps = [(b - a) ** 2 for a, b in pairwise(kept)]
            want.append((*key, len(steps), statistics.fmean(steps) ** 0.5))
    found = rows_of(rollups.rmssd_daily(df, gap, minutes, slot).drop("mean_value", "kept_from"))
    assert len(found) == len(want) > 2
    for got, expected in zip(found, sorted(want, key=repr), strict=True):
        assert got[:3] == expected[:3]
        assert got[3] == pytest.approx(expected[3], rel=1e-12)


def test_short_recordings_have_no_rmssd(spark):
    df = spark.createDataFrame([("a", T0, 1, 1.0), ("a", T0 + timedelta(minutes=29), 2, 2.0)], RAW_SIGNAL)
    assert rows_of(rollups.rmssd_daily(df)) == []


def test_hr_rollup_and_approximate_median(raw):
    rows, df = raw
    exact = {(r[0], r[1]): r for r in rows_of(rollups.daily_signal_rollup(df))}
    for series, day, low, mean, high in rows_of(rollups.daily_hr_rollup(df)):
        assert (low, high) == exact[series, day][2:4]
        assert mean == pytest.approx(exact[series, day][4])
    for row in rows_of(rollups.approx_signal_rollup(df)):
        assert row[5] == pytest.approx(exact[row[0], row[1]][5], abs=0.11)
