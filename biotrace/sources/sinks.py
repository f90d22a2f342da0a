"""Writers, appends and views."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from biotrace.operators.glucose import glucose_daily, glucose_summary
from biotrace.operators.overview import patient_overview, patient_overview_daily
from biotrace.schema import Tables

VIEWS = {
    "patient_glucose_summary": glucose_summary,
    "demo": partial(glucose_daily, ordered=False),
    "patient_overview": patient_overview,
    "patient_overview_daily": patient_overview_daily,
}


def write_table(
    df: DataFrame, path: str, mode: str = "overwrite", partition_by: str | None = None
) -> None:
    """Store a result as Parquet, by default in place of an older one."""
    writer = df.write.mode(mode)
    if partition_by is not None:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def save_table(df: DataFrame, name: str, mode: str = "overwrite") -> None:
    """Store a result as a table of the session catalog."""
    df.write.mode(mode).saveAsTable(name)


def save_bucketed(tables: Tables, buckets: int, prefix: str = "", folder: str | None = None) -> None:
    """Store the tables in the catalog, those of patients dealt and sorted by patient.

    Tables with the same number of buckets meet on the patient without a shuffle
    (``Tables.from_catalog``). A bucket should stay within a task's memory; a patient is
    never split. ``folder`` keeps the files outside the warehouse.
    """
    for name in tables.names:
        rows = getattr(tables, name)
        writer = rows.write
        if "patientid" in rows.columns:
            # One file per bucket, instead of one per bucket and task.
            dealt = rows.repartition(buckets, "patientid")
            writer = dealt.write.bucketBy(buckets, "patientid").sortBy("patientid")
        if folder is not None:
            writer = writer.option("path", f"{folder.rstrip('/')}/{name}")
        writer.mode("overwrite").saveAsTable(f"{prefix}{name}")


def with_rows_appended(df: DataFrame, rows: DataFrame) -> DataFrame:
    """A table with more rows; columns the rows do not have are NULL."""
    return df.unionByName(rows.select(_cast_to(df, rows)), allowMissingColumns=True)


RUN = "run"


def write_run(df: DataFrame, path: str, run: str) -> None:
    """Store rows under a run's key; the same key again replaces them, so a retry doubles nothing."""
    _dynamic(df.withColumn(RUN, F.lit(run)), path, RUN)


def append_rows(rows: DataFrame, like: DataFrame, path: str, run: str | None = None) -> None:
    """Append rows with some of the columns to a stored table.

    With a run's key the append can be repeated: the table's rows must all be stored by run
    (``write_run``). Without one, a repeated append stores its rows again.
    """
    appended = with_rows_appended(like.limit(0), rows)
    if run is None:
        appended.write.mode("append").parquet(path)
        return
    stored = rows.sparkSession.read.parquet(path).columns
    if RUN not in stored:
        raise ValueError(f"{path} is not stored by run")
    write_run(appended, path, run)


def _dynamic(df: DataFrame, path: str, *partition_by: str) -> None:
    """Replace the partitions that occur in the rows, and leave the others as they are."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def backfill(
    spark: SparkSession, path: str, schema: T.StructType, column: str, value: Column, *partition_by: str
) -> int:
    """Fill a column of a stored table where it is NULL or its files lack it.

    Only partitions with a row in need are read and written anew; how many there were. A
    repeated backfill finds nothing to do. ``schema`` names the stored columns, those of the
    partitions last.
    """
    stored = spark.read.schema(_with(schema, column, value, spark)).parquet(path)
    needy = stored.where(F.col(column).isNull() & value.isNotNull()).select(*partition_by).distinct()
    count = needy.count()
    if count:
        # A NULL partition is one of its own.
        same = [stored[key].eqNullSafe(needy[key]) for key in partition_by]
        rows = stored.join(needy, reduce(Column.__and__, same), "left_semi")
        filled = rows.withColumn(column, F.coalesce(F.col(column), value))
        order = [c for c in filled.columns if c not in partition_by]
        _dynamic(filled.select(*order, *partition_by), path, *partition_by)
    return count


def _with(schema: T.StructType, column: str, value: Column, spark: SparkSession) -> T.StructType:
    if column in schema.names:
        return schema
    kind = spark.createDataFrame([], schema).select(value.alias(column)).schema[0].dataType
    return T.StructType([T.StructField(column, kind), *schema.fields])


def _cast_to(df: DataFrame, rows: DataFrame) -> list[Column]:
    types = {field.name: field.dataType for field in df.schema.fields}
    return [rows[name].cast(types[name]).alias(name) for name in rows.columns]


def create_views(tables: Tables) -> None:
    """Register the base tables and the stored views over them."""
    tables.register_views()
    for name, job in VIEWS.items():
        # A view is queried further, so it carries no order.
        job(tables).createOrReplaceTempView(name)
