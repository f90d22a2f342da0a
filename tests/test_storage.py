"""Readers, writers, views, SQL functions and the meal stream."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal
from types import SimpleNamespace

import pytest
from conftest import TESTDATA, rows_of

from biotrace import session
from biotrace.functions.sql_functions import register_sql_functions
from biotrace.operators import overview
from biotrace.schema import PATIENT_BIOMETRICS, SCHEMAS, Tables
from biotrace.sources import quality, readers, sinks
from biotrace.sources.fixtures import fixture_tables
from biotrace.streaming.alerts import start_sugar_stream, sugar_alerts

SF_DIR = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return fixture_tables(spark, SF_DIR)


def meal(patient, name, sugar):
    return (patient, datetime(2024, 1, 1), name, None, None, Decimal(sugar), None)


def test_fixture_types_are_the_domain_types(tables):
    for name, schema in SCHEMAS.items():
        found = [(f.name, f.dataType) for f in getattr(tables, name).schema.fields]
        assert found == [(f.name, f.dataType) for f in schema.fields]


def test_tables_round_trip(spark, tables, tmp_path):
    for name in SCHEMAS:
        sinks.write_table(getattr(tables, name), str(tmp_path / name))
    stored = Tables.from_directory(spark, str(tmp_path))
    assert rows_of(overview.patient_overview(stored)) == rows_of(overview.patient_overview(tables))


def test_csv_readers(spark, tmp_path):
    (tmp_path / "Demographics.csv").write_text(
        "patientid,firstname,lastname,gender,hba1c,dob\n1,Ann,Lee,FEMALE,5.5,1980-01-31\n"
    )
    people = readers.read_table_csv(spark, str(tmp_path / "Demographics.csv"), "demographics")
    assert rows_of(people) == [(1, "Ann", "Lee", "FEMALE", 5.5, date(1980, 1, 31))]
    for name in ("IBI_001", "IBI_002"):
        (tmp_path / f"{name}.csv").write_text("datetime,ibi\n2024-01-01 00:00:01.5,0.8\n")
    raw = readers.read_signal_csv(spark, str(tmp_path / "IBI_*.csv"))
    at = datetime(2024, 1, 1, 0, 0, 1, 500000)
    assert rows_of(raw) == [(1, "IBI", at, 0, 0.8), (2, "IBI", at, 0, 0.8)]


def test_equal_names_in_two_folders_stay_two_patients(spark, tmp_path):
    for patient in ("001", "002"):
        (tmp_path / patient).mkdir()
        (tmp_path / patient / "HR.csv").write_text("datetime,hr\n2024-01-01 00:00:01,70\n")
    raw = readers.read_signal_csv(spark, str(tmp_path / "*" / "HR.csv"))
    assert rows_of(raw, "patientid", "sensor") == [(1, "HR"), (2, "HR")]
    assert rows_of(readers.signal_of(raw, "hr"), "patientid") == [(1,), (2,)]


def test_a_path_without_patient_is_an_error(spark, tmp_path):
    (tmp_path / "notes.csv").write_text("datetime,hr\n2024-01-01 00:00:01,70\n")
    with pytest.raises(Exception, match="no patient and sensor"):
        readers.read_signal_csv(spark, str(tmp_path / "notes.csv")).collect()


def test_csv_columns_are_taken_by_name(spark, tmp_path):
    path = tmp_path / "eda.csv"
    path.write_text("patientid,datestamp,max_eda,extra,mean_eda,min_eda\n1,2024-01-01,9,x,5,1\n")
    found = readers.read_table_csv(spark, str(path), "eda")
    assert found.columns == SCHEMAS["eda"].names
    assert rows_of(found) == [(1, date(2024, 1, 1), 1.0, 5.0, 9.0)]


def test_source_spelling_of_the_surname(spark, tmp_path):
    path = tmp_path / "people.csv"
    path.write_text("patientid,firstname,lasttname,gender,hba1c,dob\n1,Ann,Lee,FEMALE,5.5,1980-01-31\n")
    assert rows_of(readers.read_table_csv(spark, str(path), "demographics"), "lastname") == [("Lee",)]
    stored = str(tmp_path / "people")
    people = readers.read_table_csv(spark, str(path), "demographics")
    people.withColumnRenamed("lastname", "lasttname").write.parquet(stored)
    assert rows_of(readers.read_table(spark, stored, "demographics"), "lastname") == [("Lee",)]


def test_a_missing_column_is_an_error(spark, tmp_path):
    path = tmp_path / "eda.csv"
    path.write_text("patientid,datestamp,max_eda\n1,2024-01-01,9\n")
    with pytest.raises(ValueError, match="min_eda"):
        readers.read_table_csv(spark, str(path), "eda")
    spark.range(1).toDF("patientid").write.parquet(str(tmp_path / "eda"))
    with pytest.raises(ValueError, match="datestamp"):
        readers.read_table(spark, str(tmp_path / "eda"), "eda")


def test_save_table(spark, tables):
    sinks.save_table(tables.eventtype, "stored_event_types")
    assert rows_of(spark.table("stored_event_types")) == rows_of(tables.eventtype)
    spark.sql("DROP TABLE stored_event_types")


def test_views_carry_no_order(spark, tables):
    sinks.create_views(tables)
    plan = spark.sql("SELECT * FROM demo WHERE patient_day <= 3")._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan


def test_append_of_some_columns(spark, tables, tmp_path):
    path = str(tmp_path / "foodlog")
    sinks.write_table(tables.foodlog, path)
    pie = spark.sql("SELECT 1 AS patientid, 'pie' AS logged_food, 32 AS sugar")
    sinks.append_rows(pie, tables.foodlog, path)
    stored = readers.read_table(spark, path, "foodlog")
    assert stored.count() == tables.foodlog.count() + 1
    assert rows_of(stored.where("logged_food = 'pie'")) == [
        (1, None, "pie", None, None, Decimal("32.00"), None)
    ]


def test_biometrics_child_table(tables):
    child = overview.patient_biometrics(tables)
    assert child.columns == PATIENT_BIOMETRICS.names
    assert child.count() == tables.demographics.count()


def test_views_can_be_queried(spark, tables):
    sinks.create_views(tables)
    for name, job in sinks.VIEWS.items():
        assert spark.table(name).count() == job(tables).count()


def test_sql_functions(spark, make_tables):
    t = make_tables(
        demographics=[(5, "Ann", "Lee", "FEMALE", 5.5, date(2000, 2, 29))],
        dexcom=[(1, datetime(2024, 1, 13, h), 1, float(h)) for h in (0, 23)]
        + [(1, datetime(2024, 1, 14), 1, -1.0)],
    )
    t.register_views()
    register_sql_functions(spark)
    ages = spark.sql("SELECT retrieve_age(5, DATE'2025-02-28'), retrieve_age(6, DATE'2025-02-28')")
    assert rows_of(ages) == [(24, None)]
    lowest = spark.sql("SELECT * FROM retrieve_min_glucose(DATE'2024-01-13')")
    assert lowest.columns == ["min_glucose", "patient_id"]
    assert rows_of(lowest) == [(0.0, 1)]


def test_quality_checks(make_tables):
    t = make_tables(
        eventtype=[(1, "a", "b"), (1, "a", "c"), (2, "d", "e")],
        dexcom=[(1, datetime(2024, 1, 1), e, 1.0) for e in (1, 7)],
    )
    assert rows_of(quality.duplicate_keys(t.eventtype, "id")) == [(1, 2)]
    events = t.eventtype.withColumnRenamed("id", "eventid")
    assert rows_of(quality.orphan_rows(t.dexcom, events, "eventid"), "eventid") == [(7,)]


def test_stream_equals_batch_and_a_second_run_adds_nothing(spark, make_tables, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    first = [meal(1, "pie", 32), meal(1, "soup", 20), meal(2, None, 21)]
    make_tables(foodlog=first).foodlog.write.parquet(source)

    def run():
        stream = (
            spark.readStream.schema(SCHEMAS["foodlog"])
            .option("maxFilesPerTrigger", 1)
            .parquet(source)
        )
        start_sugar_stream(stream, folder).awaitTermination()

    def stored():
        return tuple(
            rows_of(spark.read.parquet(f"{folder}/{name}").drop("query", "batch"))
            for name in ("foodlog", "alerts")
        )

    run()
    batch = make_tables(foodlog=first).foodlog
    assert stored() == (rows_of(batch), rows_of(sugar_alerts(batch)))
    assert stored()[1][0][3] == "HIGH sugar content (32.00) detected for food : pie"
    run()
    assert stored() == (rows_of(batch), rows_of(sugar_alerts(batch)))

    make_tables(foodlog=[meal(3, "cake", 40)]).foodlog.write.mode("append").parquet(source)
    run()
    assert [len(rows) for rows in stored()] == [4, 3]
    batches = spark.read.parquet(f"{folder}/foodlog").select("query", "batch").distinct()
    assert batches.count() > 1
    assert batches.select("query").distinct().count() == 1


def test_a_new_checkpoint_over_filled_output_is_refused(spark, make_tables, tmp_path):
    source, folder = str(tmp_path / "in"), tmp_path / "out"
    make_tables(foodlog=[meal(1, "pie", 32)]).foodlog.write.parquet(source)
    stream = spark.readStream.schema(SCHEMAS["foodlog"]).parquet(source)
    start_sugar_stream(stream, str(folder)).awaitTermination()
    (folder / "checkpoint").rename(folder / "lost")
    with pytest.raises(ValueError, match="is new"):
        start_sugar_stream(stream, str(folder))
    assert spark.read.parquet(f"{folder}/alerts").count() == 1


def test_a_stream_that_keeps_running(spark, make_tables, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    make_tables(foodlog=[meal(1, "pie", 32)]).foodlog.write.parquet(source)
    stream = spark.readStream.schema(SCHEMAS["foodlog"]).parquet(source)
    query = start_sugar_stream(stream, folder, every="1 second")
    try:
        query.processAllAvailable()
        make_tables(foodlog=[meal(2, "cake", 40)]).foodlog.write.mode("append").parquet(source)
        query.processAllAvailable()
        assert query.isActive
    finally:
        query.stop()
    assert spark.read.parquet(f"{folder}/alerts").count() == 2


def test_a_run_removes_its_intermediate_tables(spark):
    from pathlib import Path

    with session.run_folder(spark) as root:
        folder = session.new_folder(spark, "part")
        assert folder.startswith(root)
        spark.range(3).write.parquet(folder)
        assert spark.read.parquet(folder).count() == 3
    assert not Path(root.removeprefix("file:")).exists()
    assert not session.new_folder(spark, "part").startswith(root)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    cluster = SimpleNamespace(
        conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:1")
    )
    with pytest.raises(ValueError, match="checkpoint.dir"):
        session.shared_folder(cluster)
