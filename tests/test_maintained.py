"""Stored views from deltas, appends and backfills that can be repeated, mergeable quantiles."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import pytest
from conftest import TESTDATA, rows_of
from pyspark.sql import functions as F

from biotrace.operators import quantiles
from biotrace.operators.glucose import glucose_daily
from biotrace.operators.overview import patient_overview
from biotrace.schema import RAW_SIGNAL, SCHEMAS, Tables
from biotrace.sources import readers, sinks
from biotrace.sources.fixtures import fixture_tables
from biotrace.sources.maintained import MaintainedViews

SF_DIR = f"{TESTDATA}/sf0.001"


def rounded(df) -> list[tuple]:
    """Rows with doubles to nine digits: sums of parts differ in the last bits."""
    names = sorted(df.columns)
    return [
        tuple(round(v, 9) if isinstance(v, float) else v for v in row) for row in rows_of(df, *names)
    ]


def reading(patient, day, hour, event, value):
    return (patient, datetime(2024, 1, day, hour), event, value)


def test_views_follow_late_rows_and_repeated_runs(spark, make_tables, tmp_path):
    first = dict(
        dexcom=[reading(1, 5, 8, 1, 100.0), reading(1, 6, 8, 1, None), reading(2, 5, 1, 2, 7.0)],
        eda=[(1, date(2024, 1, 5), 1.0, 2.0, 3.0)],
        hr=[(1, date(2024, 1, 5), 50.0, 60.0, 70.0), (2, date(2024, 1, 5), 1.0, 2.0, 3.0)],
        ibi=[(1, datetime(2024, 1, 5, 1), 0.5, 800.0)],
        demographics=[
            (p, f"n{p}", "x", "MALE", 5.0, date(1980, 1, 1)) for p in (1, 2, 3)
        ],
    )
    late = dict(
        dexcom=[reading(1, 4, 9, 1, 120.0), reading(1, 5, 9, 1, 101.0)],
        eda=[(1, date(2024, 1, 4), 0.0, 4.0, 9.0), (2, date(2024, 1, 4), 0.0, 4.0, 9.0)],
        hr=[(1, date(2024, 1, 4), 40.0, 62.0, 65.0)],
        ibi=[(2, datetime(2024, 1, 4, 1), 0.7, 700.0)],
    )
    views = MaintainedViews(spark, str(tmp_path))
    views.take_in(make_tables(**first), "a")
    frames = {name: spark.createDataFrame(rows, SCHEMAS[name]) for name, rows in late.items()}
    for _ in range(2):
        views.take_in(Tables(**frames), "b")
    # Partials of a run that died count nothing.
    sinks.write_run(spark.read.parquet(f"{tmp_path}/readings").drop("run"), f"{tmp_path}/readings", "dead")
    names = views.create("test_")
    try:
        whole = make_tables(**{name: rows + late.get(name, []) for name, rows in first.items()})
        assert rounded(spark.table("test_demo")) == rounded(glucose_daily(whole))
        assert rounded(spark.table("test_patient_overview")) == rounded(patient_overview(whole))
        # Rows that arrive after the views were made show up in them.
        views.take_in(Tables(dexcom=spark.createDataFrame([reading(3, 1, 0, 1, 1.0)], SCHEMAS["dexcom"])), "c")
        spark.catalog.refreshByPath(str(tmp_path))
        assert spark.table("test_demo").where("patientid = 3").count() == 1
        assert not any(t.isTemporary for t in spark.catalog.listTables() if t.name in names)
    finally:
        for name in names:
            spark.sql(f"DROP VIEW {name}")


def test_a_repeated_append_leaves_one_copy(spark, tmp_path):
    path = str(tmp_path / "foodlog")
    foodlog = fixture_tables(spark, SF_DIR).foodlog
    sinks.write_run(foodlog, path, "base")
    for run in ("1", "1", "2"):
        pie = spark.sql(f"SELECT {run} AS patientid, 'pie' AS logged_food, 32 AS sugar")
        sinks.append_rows(pie, foodlog, path, run=run)
    stored = readers.read_table(spark, path, "foodlog")
    assert stored.count() == foodlog.count() + 2
    assert rows_of(stored.where("logged_food = 'pie'"), "patientid", "sugar") == [
        (1, Decimal("32.00")),
        (2, Decimal("32.00")),
    ]
    plain = str(tmp_path / "plain")
    sinks.write_table(foodlog, plain)
    with pytest.raises(ValueError, match="not stored by run"):
        sinks.append_rows(foodlog, foodlog, plain, run="1")


def test_backfill_rewrites_partitions_in_need(spark, tmp_path):
    path = str(tmp_path / "ibi")
    rows = [(p, datetime(2024, m, 3, 1), 0.5, 800.0 + p) for m in (1, 2, 3) for p in (1, 2)]
    ibi = spark.createDataFrame([*rows, (5, None, 1.0, 2.0)], SCHEMAS["ibi"]).withColumn("month", F.month("datestamp"))
    old = ibi.where("month <= 2 OR month IS NULL")
    old.write.partitionBy("month").parquet(path)
    dated = ibi.where("month = 3").withColumn("datepart", F.to_date("datestamp"))
    dated.select(*SCHEMAS["ibi"].names, "datepart", "month").write.mode("append").partitionBy("month").parquet(path)

    def files(month) -> dict:
        return {p.name: p.stat().st_mtime_ns for p in Path(path, f"month={month}").iterdir()}

    kept = {m: files(m) for m in (3, "__HIVE_DEFAULT_PARTITION__")}
    day = F.to_date("datestamp")
    assert sinks.backfill(spark, path, ibi.schema, "datepart", day, "month") == 2
    assert {m: files(m) for m in kept} == kept
    stored = spark.read.schema(ibi.schema.add("datepart", "date")).parquet(path)
    assert rows_of(stored, "patientid", "datestamp", "datepart") == rows_of(
        ibi.withColumn("datepart", day), "patientid", "datestamp", "datepart"
    )
    assert sinks.backfill(spark, path, ibi.schema, "datepart", day, "month") == 0


@pytest.fixture(scope="module")
def signal(spark):
    """Skewed, repeated and NULL values over 20 days."""
    return spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("series"),
        (F.lit(datetime(2024, 1, 1)) + F.make_dt_interval(mins=(F.col("id") % 28800).cast("int")))
        .cast("timestamp_ntz")
        .alias("ts"),
        F.col("id").alias("seq"),
        F.when(F.col("id") % 11 > 0, F.round(F.exp(F.rand(5) * 8), 1)).alias("value"),
    )


@pytest.mark.parametrize("bound", [0.02, 0.005])
def test_merged_sketches_keep_their_rank_error(spark, signal, bound):
    assert [f.name for f in RAW_SIGNAL.fields] == signal.columns
    days = quantiles.daily_sketches(signal, bound)
    week = F.date_trunc("week", "day").alias("week")
    weeks = quantiles.merged_sketches(days, "series", week, rank_error=bound)
    by_week = signal.withColumn("day", F.to_date("ts")).select("series", week, "value")
    # A cohort merges in any order: weeks of patients, or days of shuffled patients.
    cohort = F.lit("all").alias("cohort")
    whole = [
        quantiles.merged_sketches(weeks, cohort, rank_error=bound),
        quantiles.merged_sketches(days.repartition(7).orderBy(F.rand(1)), cohort, rank_error=bound),
    ]
    shares = (0.0, 0.01, 0.3, 0.5, 0.77, 0.99, 1.0)
    found = [quantiles.rank_errors(by_week, quantiles.quantiles(weeks, *shares), "series", "week")]
    everything = signal.select(cohort, "value")
    found += [quantiles.rank_errors(everything, quantiles.quantiles(w, *shares), "cohort") for w in whole]
    for errors in found:
        rows = errors.collect()
        assert rows
        assert max(row.rank_error for row in rows) <= bound
    sizes = [w.select("samples").first()[0] for w in whole]
    assert sizes == [signal.where("value IS NOT NULL").count()] * 2


def test_a_day_without_values_merges_but_answers_nothing(spark):
    rows = [("a", datetime(2024, 1, 1), 0, None), ("a", datetime(2024, 1, 2), 1, 5.0)]
    days = quantiles.daily_sketches(spark.createDataFrame(rows, RAW_SIGNAL))
    assert rows_of(quantiles.quantiles(days, 0.5), "day", "value") == [(date(2024, 1, 2), 5.0)]
    merged = quantiles.merged_sketches(days, "series")
    assert rows_of(quantiles.quantiles(merged, 0.5), "samples", "value") == [(1, 5.0)]
