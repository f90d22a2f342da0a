"""Faulty lines, and roll-ups that grow with new files."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from conftest import rows_of

from biotrace.operators import rollups
from biotrace.sources import landing, readers, signal_store
from biotrace.sources.signal_store import SignalStore

START = datetime(2024, 1, 1, 23, 50)


def write_file(folder: Path, name: str, lines: list[str]) -> str:
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(f"{line}\n" for line in lines))
    return str(path)


def samples(count: int, first: int = 0, step: int = 60) -> list[str]:
    times = [START + timedelta(seconds=step * (first + i)) for i in range(count)]
    return [f"{t:%Y-%m-%d %H:%M:%S},{(first + i) % 7 + 0.25}" for i, t in enumerate(times)]


def test_faulty_lines_are_set_aside_with_their_place(spark, tmp_path):
    good = samples(5)
    lines = ["datetime,hr", good[0], "not a time,1", good[1], "", "2024-01-01 00:00:00", good[2]]
    lines += ["2024-01-01 00:00:00,abc", "2024-01-01 00:00:00,1,2", good[3], "2024-01-01 00:00:00,", "2024-01-01 00:00:00,NaN"]
    write_file(tmp_path, "007/HR.csv", lines)
    write_file(tmp_path, "notes.csv", ["what is this", good[4]])
    out = str(tmp_path / "out")
    paths = [str(tmp_path / "007" / "HR.csv"), str(tmp_path / "notes.csv")]
    kept = landing.load_lines(spark, paths, out, most_faulty=0.7)
    assert kept.count() == 5
    assert rows_of(kept.where("value IS NULL"), "patientid", "sensor") == [(7, "HR")]
    found = spark.read.parquet(f"{out}/quarantine")
    assert sorted(rows_of(found.where("fault <> 'path'"), "line", "fault", "text")) == [
        (3, "time", "not a time,1"),
        (6, "columns", "2024-01-01 00:00:00"),
        (8, "value", "2024-01-01 00:00:00,abc"),
        (9, "columns", "2024-01-01 00:00:00,1,2"),
        (12, "value", "2024-01-01 00:00:00,NaN"),
    ]
    assert rows_of(found.where("fault = 'path'"), "line") == [(1,), (2,)]
    plain = readers.read_signal_csv(spark, write_file(tmp_path, "008/HR.csv", ["datetime,hr", *good]))
    again = landing.load_lines(spark, str(tmp_path / "008"), str(tmp_path / "two"))
    assert rows_of(again) == rows_of(plain.select(*again.columns))


def test_line_numbers_hold_over_pieces_of_a_file(spark, tmp_path):
    lines = samples(4000)
    broken = {17: "x", 1999: "2024-01-01 00:00:00,x", 3998: ",,"}
    path = write_file(tmp_path, "1/EDA.csv", ["time,eda", *[broken.get(i, line) for i, line in enumerate(lines)]])
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        landing.load_lines(spark, path, str(tmp_path / "out"))
        assert spark.read.text(path).rdd.getNumPartitions() > 5
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    found = spark.read.parquet(str(tmp_path / "out" / "quarantine"))
    assert rows_of(found, "line", "text") == sorted(((i + 2, text) for i, text in broken.items()), key=repr)


def test_too_many_faulty_lines_are_an_error(spark, tmp_path):
    path = write_file(tmp_path, "1/EDA.csv", ["time,eda", *samples(98), "x", "y"])
    landing.load_lines(spark, path, str(tmp_path / "out"), most_faulty=0.02)
    with pytest.raises(ValueError, match="2 of 100 lines are faulty"):
        landing.load_lines(spark, path, str(tmp_path / "out"), most_faulty=0.019)
    assert spark.read.parquet(str(tmp_path / "out" / "quarantine")).count() == 2


def stored_days(store: SignalStore) -> list[tuple]:
    return rows_of(store.daily().select(*sorted(store.daily().columns)))


def test_a_second_run_equals_a_rebuild_and_reads_new_files_only(spark, tmp_path, monkeypatch):
    raw, root = tmp_path / "raw", str(tmp_path / "store")
    write_file(raw, "1/EDA.csv", ["t,v", *samples(30)])
    write_file(raw, "2/EDA.csv", samples(40, 5))
    write_file(raw, "2/HR.csv", samples(3, 5000))
    read: list[list[str]] = []
    load = signal_store.load_lines
    monkeypatch.setattr(signal_store, "load_lines", lambda s, paths, *a: read.append(paths) or load(s, paths, *a))
    store = SignalStore(spark, root)
    assert store.daily().count() == 0
    assert store.quarantine().count() == 0
    assert store.take_in(str(raw), "a") == 3
    assert store.take_in(str(raw), "a") == 0
    assert store.take_in(str(raw), "b") == 0
    untouched = {p: p.stat().st_mtime_ns for p in Path(root, "daily", "day=2024-01-05").iterdir()}
    assert untouched

    # More of the same days, by file names that sort anywhere.
    write_file(raw, "1/more/1/EDA.csv", ["t,v", *samples(25, 20), "oops"])
    assert store.take_in(str(raw), "c", most_faulty=0.1) == 1
    assert [len(paths) for paths in read] == [3, 1]
    assert read[1][0].endswith("raw/1/more/1/EDA.csv")
    assert {p: p.stat().st_mtime_ns for p in Path(root, "daily", "day=2024-01-05").iterdir()} == untouched
    assert rows_of(store.quarantine(), "line", "text") == [(27, "oops")]

    whole = SignalStore(spark, str(tmp_path / "whole"))
    assert whole.take_in(str(raw), "all", most_faulty=0.1) == 4
    assert stored_days(store) == stored_days(whole)
    every = landing.load_lines(spark, store.ledger().toPandas()["file"].tolist(), str(tmp_path / "x"), most_faulty=1)
    plain = rollups.bvp_from_raw(readers.signal_of(every, "EDA"))
    eda = store.daily().where("sensor = 'EDA'").select("patientid", "day", "min_value", "median_value", "max_value")
    assert rows_of(eda) == rows_of(plain)
    before = stored_days(store)
    store.rebuild()
    assert stored_days(store) == before


def test_a_run_that_died_is_repeated(spark, tmp_path, monkeypatch):
    raw = tmp_path / "raw"
    write_file(raw, "1/EDA.csv", samples(30))
    store = SignalStore(spark, str(tmp_path / "store"))
    refresh = SignalStore._refresh

    def die(self, runs, touched_by):
        refresh(self, runs, touched_by)
        raise RuntimeError("lost")

    monkeypatch.setattr(SignalStore, "_refresh", die)
    with pytest.raises(RuntimeError):
        store.take_in(str(raw), "a")
    monkeypatch.setattr(SignalStore, "_refresh", refresh)
    assert store.take_in(str(raw), "b") == 1
    samples_of = {row.day: row.samples for row in store.daily().collect()}
    assert samples_of == {date(2024, 1, 1): 10, date(2024, 1, 2): 20}


def test_a_changed_file_is_refused(spark, tmp_path):
    raw = tmp_path / "raw"
    write_file(raw, "1/EDA.csv", samples(30))
    store = SignalStore(spark, str(tmp_path / "store"))
    store.take_in(str(raw), "a")
    write_file(raw, "1/EDA.csv", samples(31))
    with pytest.raises(ValueError, match="changed"):
        store.take_in(str(raw), "b")


def test_partials_prune_to_the_days_of_a_run(spark, tmp_path):
    raw = tmp_path / "raw"
    write_file(raw, "1/EDA.csv", samples(30))
    store = SignalStore(spark, str(tmp_path / "store"))
    store.take_in(str(raw), "a")
    values = store._read("values", signal_store._VALUES)
    chosen = values.where(signal_store._one_of("day", [date(2024, 1, 1)]) & values.run.isin(["a"]))
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    pruned = plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert "run#" in pruned
    assert "day#" in pruned
    assert chosen.select("day").distinct().count() == 1
