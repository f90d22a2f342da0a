"""Stored views that are kept up from the rows of each run.

A run's rows are reduced to partials that add up: sums, counts, least and largest values per
patient, event and day. They are stored under the run's key; the list of finished runs comes
last, and the views count only runs it names, so a run that died is repeated without harm.
Late rows of any day are just further partials.

The views are entries of the catalog over the partials and outlive the session that made
them. The newest row of a patient in ``demographics``, by the order of run keys, counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biotrace.operators.glucose import GLUCOSE
from biotrace.plans.fanout import per_patient
from biotrace.schema import Tables
from biotrace.sources.sinks import RUN, write_run


def _sum(column: str, name: str) -> list:
    return [F.sum(column).alias(f"{name}_sum"), F.count(column).alias(f"{name}_rows")]


def readings(t: Tables) -> DataFrame:
    return t.dexcom.groupBy("patientid", "eventid", F.to_date("datestamp").alias("day")).agg(
        *_sum(GLUCOSE, "glucose")
    )


def skin(t: Tables) -> DataFrame:
    return per_patient(
        t.eda, eda_sum=F.sum("mean_eda"), eda_rows=F.count("mean_eda"), maxeda=F.max("max_eda")
    )


def heart(t: Tables) -> DataFrame:
    return per_patient(
        t.hr,
        minhr=F.min("min_hr"),
        maxhr=F.max("max_hr"),
        hr_sum=F.sum("mean_hr"),
        hr_rows=F.count("mean_hr"),
    )


def beats(t: Tables) -> DataFrame:
    return per_patient(
        t.ibi,
        ibi_sum=F.sum("mean_ibi_ms"),
        ibi_rows=F.count("mean_ibi_ms"),
        rmssd_sum=F.sum("rmssd_ms"),
        rmssd_rows=F.count("rmssd_ms"),
    )


# Partial, the table it comes from, and how.
PARTIALS = {
    "readings": ("dexcom", readings),
    "skin": ("eda", skin),
    "heart": ("hr", heart),
    "beats": ("ibi", beats),
    "people": ("demographics", lambda t: t.demographics),
}

# A double as the decimal it stands for, half away from zero, as functions.exprs.round_half_up.
_EXACT = "try_cast(format_string('%.14e', {0}) AS DECIMAL(38,18))"
_ROUNDED = f"coalesce(CAST(round({_EXACT}, 2) AS DOUBLE), {{0}})"

_DEMO = f"""
    SELECT day, patientid, {_ROUNDED.format("glucose")} AS avg_glucose,
           datediff(day, min(day) OVER (PARTITION BY patientid)) + 1 AS patient_day
    FROM (
        SELECT day, patientid, sum(glucose_sum) / nullif(sum(glucose_rows), 0) AS glucose
        FROM {{readings}} GROUP BY day, patientid
    )"""

# EDA hangs on the readings, heart rate on EDA and IBI on heart rate.
_OVERVIEW = """
    SELECT p.patientid, firstname, lastname, gender, hba1c, eventid,
           glucose_sum / nullif(glucose_rows, 0) AS avg_glucose,
           eda_sum / nullif(eda_rows, 0) AS avg_eda, maxeda, minhr, maxhr,
           hr_sum / nullif(hr_rows, 0) AS meanhr, ibi_sum / nullif(ibi_rows, 0) AS meanibi,
           rmssd_sum / nullif(rmssd_rows, 0) AS rmssd_avg
    FROM (
        SELECT patientid, newest.* FROM (
            SELECT patientid, max_by(struct(firstname, lastname, gender, hba1c), run) AS newest
            FROM {people} GROUP BY patientid)
    ) p
    LEFT JOIN (
        SELECT patientid, eventid, sum(glucose_sum) AS glucose_sum, sum(glucose_rows) AS glucose_rows
        FROM {readings} GROUP BY patientid, eventid
    ) r ON r.patientid = p.patientid
    LEFT JOIN (
        SELECT patientid, sum(eda_sum) AS eda_sum, sum(eda_rows) AS eda_rows, max(maxeda) AS maxeda
        FROM {skin} GROUP BY patientid
    ) s ON s.patientid = r.patientid
    LEFT JOIN (
        SELECT patientid, min(minhr) AS minhr, max(maxhr) AS maxhr,
               sum(hr_sum) AS hr_sum, sum(hr_rows) AS hr_rows
        FROM {heart} GROUP BY patientid
    ) h ON h.patientid = s.patientid
    LEFT JOIN (
        SELECT patientid, sum(ibi_sum) AS ibi_sum, sum(ibi_rows) AS ibi_rows,
               sum(rmssd_sum) AS rmssd_sum, sum(rmssd_rows) AS rmssd_rows
        FROM {beats} GROUP BY patientid
    ) b ON b.patientid = h.patientid"""

VIEWS = {"demo": _DEMO, "patient_overview": _OVERVIEW}


class MaintainedViews:
    """Partials below ``root`` and the views over them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def take_in(self, rows: Tables, run: str) -> None:
        """Add new rows of some or all tables under a run's key.

        The same key again replaces what it brought, if all its tables are given again.
        """
        for name, (table, reduced) in PARTIALS.items():
            if table in rows.names:
                write_run(reduced(rows), f"{self.root}/{name}", run)
        finished = self.spark.sql("SELECT 1 AS done").coalesce(1)
        write_run(finished, f"{self.root}/runs", run)

    def _finished(self, name: str) -> str:
        """Rows of finished runs, as a subquery."""
        done = f"SELECT {RUN} FROM parquet.`{self.root}/runs`"
        return f"(SELECT * FROM parquet.`{self.root}/{name}` WHERE {RUN} IN ({done}))"

    def create(self, prefix: str = "") -> list[str]:
        """Enter the views in the catalog; every partial must have had rows. Their names."""
        names = []
        for name, text in VIEWS.items():
            filled = text.format(**{partial: self._finished(partial) for partial in PARTIALS})
            names.append(f"{prefix}{name}")
            self.spark.sql(f"CREATE OR REPLACE VIEW {names[-1]} AS {filled}")
        return names
