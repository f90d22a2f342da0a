"""Typed readers that take columns by name and refuse files without them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from biotrace.schema import LONG, PATIENT_SIGNAL, RAW_SIGNAL, REAL, SCHEMAS, TEXT, TIME, struct

# Spellings of columns in source files.
ALIASES = {"lasttname": "lastname"}


def _named(columns: list[str], wanted: T.StructType, path: str) -> dict[str, str]:
    """The file's spelling of every wanted column; an error if one is missing."""
    found: dict[str, str] = {}
    for column in columns:
        key = column.strip().lower()
        found.setdefault(ALIASES.get(key, key), column)
    missing = [name for name in wanted.names if name.lower() not in found]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)} among {', '.join(columns)}")
    return {name: found[name.lower()] for name in wanted.names}


def _parquet(spark: SparkSession, path: str, wanted: T.StructType) -> DataFrame:
    """Parquet with the wanted columns; the file's own types are checked by the scan."""
    spelled = _named(spark.read.parquet(path).columns, wanted, path)
    stored = T.StructType([T.StructField(spelled[f.name], f.dataType) for f in wanted.fields])
    frame = spark.read.schema(stored).parquet(path)
    return frame.select(*[F.col(f"`{spelled[f.name]}`").alias(f.name) for f in wanted.fields])


def _csv(spark: SparkSession, path: str, wanted: T.StructType, **options) -> DataFrame:
    """CSV with a header in any order; every file of a folder has the same header.

    The header of the first file gives the order, and Spark compares the header of every
    file with it. Further columns are read over.
    """
    columns = spark.read.options(**options).csv(path, header=True).columns
    spelled = _named(columns, wanted, path)
    kinds = {spelled[f.name]: f.dataType for f in wanted.fields}
    stored = T.StructType([T.StructField(c, kinds.get(c, TEXT)) for c in columns])
    frame = (
        spark.read.schema(stored)
        .options(**options)
        .csv(path, header=True, mode="FAILFAST", enforceSchema=False)
    )
    return frame.withColumnsRenamed({spelled[f.name]: f.name for f in wanted.fields})


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One domain table from Parquet."""
    return _parquet(spark, path, SCHEMAS[table])


def read_table_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One domain table from CSV with a header, as ``Demographics.csv``."""
    return _csv(spark, path, SCHEMAS[table]).select(*SCHEMAS[table].names)


def read_signal(spark: SparkSession, path: str) -> DataFrame:
    """Raw samples that already have the columns of a roll-up, from Parquet."""
    return _parquet(spark, path, RAW_SIGNAL)


# Paths of a sensor file: ``007/EDA.csv`` or ``EDA_007.csv``; named groups say which is which.
PATHS = (r"(?i)/(?<patient>\d+)/(?<sensor>[a-z]+)\.csv[^/]*$", r"(?i)/(?<sensor>[a-z]+)_(?<patient>\d+)\.csv[^/]*$")


def path_group(path: Column, name: str, patterns: tuple[str, ...]) -> Column:
    """What a named group of the first pattern that matches the path holds, or null."""
    choices = []
    for pattern in patterns:
        names = re.findall(r"\(\?<([a-z]+)>", pattern)
        plain = re.sub(r"\?<[a-z]+>", "", pattern)
        found = F.regexp_extract(path, plain, names.index(name) + 1)
        choices.append(F.when(found != "", found))
    return F.coalesce(*choices)


def read_signal_csv(spark: SparkSession, path: str, patterns: tuple[str, ...] = PATHS) -> DataFrame:
    """Raw ``timestamp, value`` files with a header, one file per sensor and patient.

    Patient and sensor come from the whole path of each file; one that no pattern matches is
    an error. The two columns are taken by place. Ties in time are ordered by value.
    """
    raw = spark.read.schema(struct(ts=TIME, value=REAL)).csv(path, header=True, mode="FAILFAST")
    file = F.col("_metadata.file_path")
    unknown = F.raise_error(F.concat(F.lit("no patient and sensor in the path "), file))
    patient = F.coalesce(path_group(file, "patient", patterns), unknown.cast("string"))
    return raw.select(
        patient.cast(LONG).alias("patientid"),
        F.upper(path_group(file, "sensor", patterns)).alias("sensor"),
        "ts",
        F.lit(0).cast(LONG).alias("seq"),
        "value",
    )


def signal_of(samples: DataFrame, sensor: str) -> DataFrame:
    """Samples of one sensor, with the columns that the tables are built from."""
    return samples.where(F.col("sensor") == sensor.upper()).select(*PATIENT_SIGNAL.names)
