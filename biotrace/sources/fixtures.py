"""Domain tables derived from the shared test tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from biotrace.functions.exprs import whole_division
from biotrace.schema import INT, LONG, MONEY, REAL, TEXT, TIME, Tables, struct

# Only the columns the adapter reads; a given schema also spares the footer job.
_DRIVER_SCHEMAS = {
    "customer": struct(c_custkey=LONG),
    "part": struct(p_partkey=LONG, p_name=TEXT),
    "orders": struct(o_orderkey=LONG, o_custkey=LONG, o_totalprice=REAL),
    "lineitem": struct(
        l_orderkey=LONG,
        l_partkey=LONG,
        l_linenumber=INT,
        l_quantity=REAL,
        l_extendedprice=REAL,
        l_tax=REAL,
    ),
    "events": struct(event_id=LONG, ts=TIME, user_id=LONG, event_type=TEXT, value=REAL),
}

# The event dimension of FIXTURES.md. Type 6 has no readings.
EVENT_TYPES = [
    (1, "EGV", "Estimated Glucose Value"),
    (2, "Exercise", "Walk"),
    (3, "Insulin", "Fast-Acting"),
    (4, "Calibration", "Manual"),
    (5, "Alert", "Low"),
    (6, "Carbs", "Snack"),
]
UNUSED_EVENT = 6


def driver_schema(name: str) -> T.StructType:
    return _DRIVER_SCHEMAS[name]


def demographics(customer: DataFrame, part: DataFrame) -> DataFrame:
    key = F.col("c_custkey")

    def word(n: int) -> Column:
        text = F.split_part("p_name", F.lit(" "), F.lit(n))
        return F.concat(F.upper(F.left(text, F.lit(1))), F.substr(text, F.lit(2)))

    return customer.join(part, F.col("p_partkey") == key).select(
        key.alias("patientid"),
        word(1).alias("firstname"),
        word(2).alias("lastname"),
        F.when(key % 2 == 0, "FEMALE").otherwise("MALE").alias("gender"),
        F.round(5.2 + (key % 13) * 0.1, 1).alias("hba1c"),
        F.date_add(F.lit("1955-01-01").cast("date"), (key * 37 % 11000).cast("int")).alias("dob"),
    )


def _event_code() -> Column:
    code = F.lit(5)
    for number, name in [(4, "signup"), (3, "purchase"), (2, "click"), (1, "view")]:
        code = F.when(F.col("event_type") == name, number).otherwise(code)
    return code


def eventtype(events: DataFrame) -> DataFrame:
    """The types that occur, and one without readings."""
    names = ", ".join(str(row) for row in EVENT_TYPES)
    names = events.sparkSession.sql(
        f"SELECT * FROM VALUES {names} AS t(id, event_type, event_subtype)"
    )
    used = events.select(_event_code().alias("used")).distinct()
    known = names.join(used, F.col("id") == F.col("used"), "left")
    return known.where(F.col("used").isNotNull() | (F.col("id") == UNUSED_EVENT)).drop("used")


def dexcom(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("patientid"),
        F.col("ts").alias("datestamp"),
        _event_code().alias("eventid"),
        F.when(F.col("event_id") % 97 != 0, F.round(F.col("value") + 40, 2)).alias(
            "glucose_value_mgdl"
        ),
    )


def foodlog(lineitem: DataFrame, orders: DataFrame, part: DataFrame) -> DataFrame:
    minutes = (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 131) % 43200
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    # floor(x + 0.5) rounds amounts, which are never negative, without leaving doubles.
    cents = F.floor(F.col("l_extendedprice") + 0.5).cast("decimal(12,0)")
    fiber = F.floor(F.col("l_tax") * 100 + 0.5)
    # A number of partitions that is asked for stays. Else the join, where it sorts the lines,
    # is merged into about one task per core, which then holds more the more lines there are.
    partitions = int(orders.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    orders = orders.repartition(partitions, "o_orderkey")
    return (
        lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("o_custkey").alias("patientid"),
            F.timestamp_add("MINUTE", minutes, start).alias("datetime"),
            F.col("p_name").alias("logged_food"),
            (cents * F.lit("0.01").cast("decimal(2,2)")).cast(MONEY).alias("calorie"),
            F.col("l_quantity").cast(MONEY).alias("protein"),
            (51 - F.col("l_quantity")).cast(MONEY).alias("sugar"),
            fiber.cast(MONEY).alias("dietary_fiber"),
        )
    )


def eda(orders: DataFrame) -> DataFrame:
    """Every order is a sample: ten customers are one patient, and a day lies in January 2024."""
    start = F.lit("2024-01-01").cast("date")
    return (
        orders.groupBy(
            whole_division("o_custkey", 10).alias("patientid"),
            F.date_add(start, (F.col("o_orderkey") % 30).cast("int")).alias("datestamp"),
        )
        .agg(
            (F.min("o_totalprice") / 8000).alias("min_eda"),
            F.round(F.avg("o_totalprice") / 8000, 6).alias("mean_eda"),
            (F.max("o_totalprice") / 8000).alias("max_eda"),
        )
    )


def hr(events: DataFrame) -> DataFrame:
    def beat(value: Column) -> Column:
        return F.round(45 + value * (F.col("user_id") % 4 + 1) / 3, 6)

    return events.groupBy(
        F.col("user_id").alias("patientid"), F.to_date("ts").alias("datestamp")
    ).agg(
        beat(F.min("value")).alias("min_hr"),
        beat(F.avg("value")).alias("mean_hr"),
        beat(F.max("value")).alias("max_hr"),
    )


def ibi(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("patientid"),
        F.col("ts").alias("datestamp"),
        (F.col("value") * (F.col("user_id") % 5 + 1) / 1800).alias("rmssd_ms"),
        (F.col("value") + 600).alias("mean_ibi_ms"),
    )


def raw_signal(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_type").alias("series"), "ts", F.col("event_id").alias("seq"), "value"
    )


def patient_signal(events: DataFrame) -> DataFrame:
    """Raw samples by patient, as the files of one sensor."""
    return events.select(
        F.col("user_id").alias("patientid"), "ts", F.col("event_id").alias("seq"), "value"
    )


def fixture_tables(spark: SparkSession, sf_dir: str) -> Tables:
    def scan(name: str) -> DataFrame:
        return spark.read.schema(driver_schema(name)).parquet(f"{sf_dir}/{name}.parquet")

    return Tables(
        demographics=lambda: demographics(scan("customer"), scan("part")),
        dexcom=lambda: dexcom(scan("events")),
        eventtype=lambda: eventtype(scan("events")),
        foodlog=lambda: foodlog(scan("lineitem"), scan("orders"), scan("part")),
        eda=lambda: eda(scan("orders")),
        hr=lambda: hr(scan("events")),
        ibi=lambda: ibi(scan("events")),
        raw_signal=lambda: raw_signal(scan("events")),
        patient_signal=lambda: patient_signal(scan("events")),
    )
