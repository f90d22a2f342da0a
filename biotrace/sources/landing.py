"""Sensor files as they come: every line is read, faulty ones are set aside with their place.

A line becomes a sample or gets a fault: ``path`` (the file tells no patient and sensor),
``columns`` (not a time and a value), ``time`` or ``value`` (not one, or not finite). A first
line without a time is the header. Blank lines are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from biotrace.schema import LONG
from biotrace.sources.readers import PATHS, path_group

SAMPLE = ("patientid", "sensor", "ts", "seq", "value")


def _finite(value: Column) -> Column:
    return F.abs(value) < float("inf")


def read_lines(spark: SparkSession, paths: str | list[str], patterns: tuple[str, ...] = PATHS) -> DataFrame:
    """Samples (SAMPLE, fault NULL), and faulty lines with their file and text.

    ``piece`` and ``place`` say where in its file a line stands; ``line_numbers`` turns them
    into a number.
    """
    raw = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("piece"),
        F.monotonically_increasing_id().alias("place"),
        F.col("value").alias("text"),
    )
    fields = F.from_csv(
        "text",
        "ts STRING, value STRING, broken STRING",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"},
    )
    patient = path_group(F.col("file"), "patient", patterns).cast(LONG)
    sensor = F.upper(path_group(F.col("file"), "sensor", patterns))
    given = F.col("fields.value").isNotNull()
    parsed = raw.withColumn("fields", fields).select(
        "file",
        "piece",
        "place",
        "text",
        patient.alias("patientid"),
        sensor.alias("sensor"),
        F.expr("try_cast(trim(fields.ts) AS TIMESTAMP_NTZ)").alias("ts"),
        F.lit(0).cast(LONG).alias("seq"),
        F.expr("try_cast(trim(fields.value) AS DOUBLE)").alias("value"),
        F.col("fields.broken").isNotNull().alias("broken"),
        given.alias("given"),
    )
    fault = (
        F.when(F.col("patientid").isNull() | F.col("sensor").isNull(), "path")
        .when(F.col("broken"), "columns")
        .when(F.col("ts").isNull(), "time")
        .when(F.col("given") & ~F.coalesce(_finite(F.col("value")), F.lit(False)), "value")
    )
    return (
        parsed.withColumn("fault", fault)
        .where((F.trim("text") != "") | F.col("fault").isNull())
        .withColumn("text", F.when(F.col("fault").isNotNull(), F.col("text")))
        .select(*SAMPLE, "fault", "file", "piece", "place", "text")
    )


def line_numbers(faulty: DataFrame, paths: str | list[str]) -> DataFrame:
    """(file, line, fault, text) of faulty lines; a header is none.

    A file may be read in pieces by several tasks, in each of which lines stand in order. A
    line's number is what the earlier pieces hold and its place in its own. Counting the
    lines of a piece reads the files once more; only one row per piece leaves the tasks.
    """
    pieces = (
        faulty.sparkSession.read.text(paths)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("piece"),
            F.monotonically_increasing_id().alias("place"),
        )
        .groupBy("file", "piece")
        .agg(F.min("place").alias("first"), F.count("*").alias("lines"))
    )
    earlier = Window.partitionBy("file").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select("file", "piece", "first", F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("before"))
    line = F.col("before") + F.col("place") - F.col("first") + 1
    return (
        faulty.join(starts, ["file", "piece"])
        .select("file", line.alias("line"), "fault", "text")
        .where((F.col("line") > 1) | F.col("fault").isin("path", "value"))
    )


def load_lines(
    spark: SparkSession,
    paths: str | list[str],
    folder: str,
    patterns: tuple[str, ...] = PATHS,
    most_faulty: float = 0.01,
) -> DataFrame:
    """Load files below a folder, in one pass over them, and return the samples.

    ``folder/lines`` gets the samples, ``folder/quarantine`` the faulty lines. Loading again
    replaces both. More faulty lines than the share ``most_faulty`` of all is an error; the
    quarantine stays to be looked at.
    """
    folder = folder.rstrip("/")
    lines = read_lines(spark, paths, patterns)
    written = lines.withColumn("good", F.col("fault").isNull())
    written.write.mode("overwrite").partitionBy("good").parquet(f"{folder}/lines")
    stored = spark.read.schema(written.schema).parquet(f"{folder}/lines")
    faulty = line_numbers(stored.where(~F.col("good")), paths)
    faulty.write.mode("overwrite").parquet(f"{folder}/quarantine")
    samples = stored.where(F.col("good"))
    good, bad = samples.count(), spark.read.parquet(f"{folder}/quarantine").count()
    if bad > most_faulty * (good + bad):
        raise ValueError(f"{bad} of {good + bad} lines are faulty: see {folder}/quarantine")
    return samples.select(*SAMPLE)
