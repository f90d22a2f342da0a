"""Domain schemas and the handle every job receives."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

AsOf = str | date | Column | None


LONG, INT, TEXT = T.LongType(), T.IntegerType(), T.StringType()
REAL, MONEY = T.DoubleType(), T.DecimalType(12, 2)
DAY = T.DateType()
# Event times carry no zone: a wristband logs wall-clock time, and hours and
# days must not move with the session time zone.
TIME = T.TimestampNTZType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


SCHEMAS: dict[str, T.StructType] = {
    "demographics": struct(
        patientid=LONG, firstname=TEXT, lastname=TEXT, gender=TEXT, hba1c=REAL, dob=DAY
    ),
    "dexcom": struct(patientid=LONG, datestamp=TIME, eventid=INT, glucose_value_mgdl=REAL),
    "eventtype": struct(id=INT, event_type=TEXT, event_subtype=TEXT),
    "foodlog": struct(
        patientid=LONG,
        datetime=TIME,
        logged_food=TEXT,
        calorie=MONEY,
        protein=MONEY,
        sugar=MONEY,
        dietary_fiber=MONEY,
    ),
    "eda": struct(patientid=LONG, datestamp=DAY, min_eda=REAL, mean_eda=REAL, max_eda=REAL),
    "hr": struct(patientid=LONG, datestamp=DAY, min_hr=REAL, mean_hr=REAL, max_hr=REAL),
    "ibi": struct(patientid=LONG, datestamp=TIME, rmssd_ms=REAL, mean_ibi_ms=REAL),
}

# Blood volume pulse of a patient and day; no question reads it.
BVP = struct(patientid=LONG, datestamp=DAY, min_bvp=REAL, median_bvp=REAL, max_bvp=REAL)

# One sensor sample; seq breaks ties between samples with the same time.
RAW_SIGNAL = struct(series=TEXT, ts=TIME, seq=LONG, value=REAL)
PATIENT_SIGNAL = struct(patientid=LONG, ts=TIME, seq=LONG, value=REAL)

# Child table: the demographics columns plus two per-patient markers.
PATIENT_BIOMETRICS = T.StructType(
    SCHEMAS["demographics"].fields + struct(max_eda=REAL, mean_hr=REAL).fields
)


class Tables:
    """The seven domain tables, each opened on first use.

    ``Tables(dexcom=frame, ...)`` takes DataFrames, or functions without
    arguments that return one, so a job pays only for the tables it touches.
    """

    def __init__(self, **sources: DataFrame | Callable[[], DataFrame]):
        self._sources = sources
        self._opened: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._opened:
            if name not in self._sources:
                raise AttributeError(f"table {name!r} was not given")
            source = self._sources[name]
            self._opened[name] = source() if callable(source) else source
        return self._opened[name]

    @property
    def names(self) -> list[str]:
        return list(self._sources)

    def register_views(self, prefix: str = "") -> None:
        """Expose every table to ``spark.sql`` as a temporary view."""
        for name in self.names:
            getattr(self, name).createOrReplaceTempView(prefix + name)

    @classmethod
    def from_directory(cls, spark: SparkSession, root: str) -> Tables:
        """Tables stored as ``root/<table>`` in Parquet."""
        from biotrace.sources.readers import read_table

        def opener(name: str) -> Callable[[], DataFrame]:
            return lambda: read_table(spark, f"{root.rstrip('/')}/{name}", name)

        return cls(**{name: opener(name) for name in SCHEMAS})

    @classmethod
    def from_catalog(cls, spark: SparkSession, prefix: str = "") -> Tables:
        """Tables of the catalog, which keep the buckets they were stored with."""

        def opener(name: str) -> Callable[[], DataFrame]:
            return lambda: spark.table(f"{prefix}{name}").select(*SCHEMAS[name].names)

        return cls(**{name: opener(name) for name in SCHEMAS})
