"""Late beats against the roll-up of all samples at once."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from conftest import rows_of

from biotrace.operators import rollups
from biotrace.schema import PATIENT_SIGNAL
from biotrace.streaming.beats import latest_ibi, start_beat_stream

START = datetime(2024, 1, 1, 8)
COLUMNS = ["patientid", "day", "datestamp", "rmssd_ms", "mean_ibi_ms", "steps"]


def beats(patient: int, first: float, count: int, step: float = 30) -> list[tuple]:
    return [
        (patient, START + timedelta(seconds=first + step * i), i, float((patient * 31 + i * 17) % 23))
        for i in range(count)
    ]


def run(spark, folder: str, lots: list[list[tuple]], gap: float) -> None:
    """Each lot is a micro-batch."""
    for lot in lots:
        frame = spark.createDataFrame(lot, PATIENT_SIGNAL)
        frame.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(PATIENT_SIGNAL).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    start_beat_stream(stream, folder, gap_seconds=gap).awaitTermination()


def plain(spark, rows: list[tuple], gap: float) -> list[tuple]:
    raw = spark.createDataFrame(rows, PATIENT_SIGNAL).withColumnRenamed("patientid", "series")
    found = rollups.rmssd_daily(raw, gap).withColumnsRenamed(
        {"series": "patientid", "kept_from": "datestamp", "rmssd": "rmssd_ms", "mean_value": "mean_ibi_ms"}
    )
    return rows_of(found, *COLUMNS)


def test_a_late_beat_joins_two_runs(spark, tmp_path):
    """Two runs of 20 minutes, and a later one of 30; a late beat makes one run of the first two."""
    folder = str(tmp_path)
    early = beats(1, 0, 41) + beats(1, 1290, 41) + beats(1, 9000, 70) + beats(2, 0, 70)
    run(spark, folder, [early], gap=60)
    first = {row.patientid: row.datestamp for row in latest_ibi(spark, folder).collect()}
    assert first == {1: START + timedelta(seconds=9000), 2: START}
    late = [(1, START + timedelta(seconds=1245), 7, 3.0)]
    run(spark, folder, [late], gap=60)
    second = {row.patientid: row.datestamp for row in latest_ibi(spark, folder).collect()}
    assert second == {1: START, 2: START}
    assert rows_of(latest_ibi(spark, folder), *COLUMNS) == plain(spark, early + late, 60)
    # Only the touched patient-day was worked out again.
    newest = spark.read.parquet(f"{folder}/ibi").where("batch = 1")
    assert rows_of(newest, "series") == [(1,)]


def test_shuffled_arrival_equals_all_at_once(spark, tmp_path):
    rows = [b for p in range(5) for b in beats(p, p * 100, 300, 40 + p) + beats(p, 70000, 200, 50)]
    rows += [(9, None, 0, 1.0), (9, START, 0, None)]
    random.Random(4).shuffle(rows)
    lots = [rows[i::5] for i in range(5)]
    run(spark, str(tmp_path), lots, gap=90)
    assert rows_of(latest_ibi(spark, str(tmp_path)), *COLUMNS) == plain(spark, rows, 90)


def test_a_lost_checkpoint_is_refused(spark, tmp_path):
    run(spark, str(tmp_path), [beats(1, 0, 70)], gap=60)
    (tmp_path / "checkpoint").rename(tmp_path / "lost")
    with pytest.raises(ValueError, match="is new"):
        run(spark, str(tmp_path), [beats(2, 0, 70)], gap=60)
