"""The jobs under their question keys, with the parameters of FIXTURES.md."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from biotrace.checks.oracle import AS_OF
from biotrace.functions.exprs import round_half_up
from biotrace.functions.sql_functions import register_sql_functions
from biotrace.operators import (
    cardio,
    demographics,
    events,
    glucose,
    nutrition,
    overview,
    quantiles,
    rollups,
    series,
)
from biotrace.plans.membership import rows_missing_in
from biotrace.schema import SCHEMAS, Tables
from biotrace.session import new_folder
from biotrace.sources.fixtures import driver_schema, fixture_tables, foodlog
from biotrace.sources.maintained import MaintainedViews
from biotrace.sources.quality import duplicate_keys, orphan_rows
from biotrace.sources.readers import read_table
from biotrace.sources.signal_store import SignalStore
from biotrace.sources.sinks import append_rows, backfill, save_bucketed, with_rows_appended, write_run
from biotrace.streaming.alerts import start_sugar_stream, sugar_alerts
from biotrace.streaming.beats import latest_ibi, start_beat_stream

Query = Callable[[SparkSession, str], DataFrame]
Job = Callable[..., DataFrame]


def comparable(df: DataFrame) -> DataFrame:
    """The same rows in types that two engines print alike."""

    def plain(field: T.StructField):
        column = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, T.DecimalType):
            column = F.round(column, 4).cast("double")
        elif isinstance(kind, T.DoubleType):
            column = round_half_up(column, 4)
        elif isinstance(kind, T.IntegerType):
            column = column.cast("bigint")
        elif isinstance(kind, T.DateType):
            column = column.cast("string")
        return column.alias(field.name)

    return df.select(*[plain(field) for field in df.schema.fields])


def _aged(job: Job, **options) -> Job:
    return lambda t: job(t, as_of=AS_OF, **options)


def _with(job: Job, *args, **options) -> Job:
    return lambda t: job(t, *args, **options)


def _biomarkers(t: Tables) -> DataFrame:
    array = F.col("biomarkers")
    return overview.biomarkers(t).select(
        "pid", array[0].alias("min_glucose"), array[1].alias("mean_hr"), array[2].alias("max_eda")
    )


def _foodlog_append(t: Tables) -> DataFrame:
    pie = t.foodlog.sparkSession.sql("SELECT 1 AS patientid, 'pie' AS logged_food, 32 AS sugar")
    return with_rows_appended(t.foodlog, pie)


def _food_at_reading_exact(t: Tables) -> DataFrame:
    """Meals at the very time of a reading, where the sensor stores full minutes."""
    minute = F.date_trunc("minute", "datestamp").cast("timestamp_ntz")
    readings = t.dexcom.withColumn("datestamp", minute)
    return nutrition.food_at_reading(Tables(dexcom=readings, foodlog=t.foodlog))


def _hrv_from_raw(t: Tables) -> DataFrame:
    """A question answered on a table that was built from raw samples."""
    return cardio.hrv(Tables(ibi=rollups.ibi_from_raw(t.patient_signal, gap_seconds=21600)))


def _orphan_days(t: Tables) -> DataFrame:
    """Beat rows on patient-days without EDA."""
    child = t.ibi.withColumn("day", F.to_date("datestamp"))
    parent = t.eda.withColumn("day", F.to_date("datestamp"))
    return orphan_rows(child, parent, "patientid", "day").select(*child.columns)


def _week_quantiles(t: Tables, rank_error: float = 0.01) -> DataFrame:
    """Quantiles of weeks from merged sketches of days, and whether each is within its bound."""
    week = F.date_trunc("week", "day").cast("date").alias("week")
    days = quantiles.daily_sketches(t.raw_signal, rank_error)
    weeks = quantiles.merged_sketches(days, "series", week, rank_error=rank_error)
    answers = quantiles.quantiles(weeks, 0.05, 0.25, 0.5, 0.75, 0.95)
    raw = t.raw_signal.withColumn("day", F.to_date("ts")).select("series", week, "value")
    errors = quantiles.rank_errors(raw, answers, "series", "week")
    within = (F.col("rank_error") <= rank_error).alias("within_bound")
    return errors.select("series", "week", "share", "samples", within)


def _orphan_days_filtered(t: Tables) -> DataFrame:
    child = t.ibi.withColumn("day", F.to_date("datestamp"))
    parent = t.eda.withColumn("day", F.to_date("datestamp"))
    found = rows_missing_in(child, parent, "patientid", "day", bits=2**17)
    return found.select(*child.columns)


JOBS: dict[str, Job] = {
    "egv_above": glucose.egv_above,
    "protein_patients": nutrition.protein_patients,
    "dinner_top": nutrition.dinner_top,
    "dinner_top_hour": nutrition.dinner_top_hour,
    "stress_days_top": cardio.stress_days_top,
    "stress_days": cardio.stress_days,
    "eda_day_leader": cardio.eda_day_leader,
    "stress_profile": cardio.stress_profile,
    "least_healthy": cardio.least_healthy,
    "hr_out_low_hrv": cardio.hr_out_low_hrv,
    "least_healthy_left": cardio.least_healthy_left,
    "patient_biometrics": overview.patient_biometrics,
    "gender_pct": demographics.gender_pct,
    "eda_top": cardio.eda_top,
    "prediabetic": demographics.prediabetic,
    "eda_max_patient": _aged(cardio.eda_max_patient),
    "eda_high_patients": _aged(cardio.eda_high_patients),
    "name_prefix": _with(demographics.name_prefix, "S"),
    "age_hist10": _aged(demographics.age_hist10),
    "age_decades": _aged(demographics.age_decades),
    "age_ranges": _aged(demographics.age_ranges),
    "age_hist20": _aged(demographics.age_hist20),
    "egg_word": _with(nutrition.food_with_word, "ring", "rings"),
    "egg_only": _with(nutrition.food_named, "red ring", "cold ring"),
    "null_glucose": glucose.null_glucose,
    "glucose_dense_rank": glucose.glucose_dense_rank,
    "glucose_rank": glucose.glucose_rank,
    "glucose_rank_in_patient": glucose.glucose_rank_in_patient,
    "hrv": cardio.hrv,
    "calorie_split": nutrition.calorie_split,
    "calorie_split_all": _with(nutrition.calorie_split, None),
    "random_patients": _with(demographics.random_patients, seed=7),
    "series": lambda t: series.column_series(t.demographics, "patientid"),
    "hr_draws": series.hr_draws,
    "youngest_foods": _aged(nutrition.youngest_foods),
    "last_letter": _with(demographics.last_letter, "l"),
    "last_letter_regex": _with(demographics.last_letter_regex, "l"),
    "hours_out_of_range": glucose.hours_out_of_range,
    "minutes_recorded": glucose.minutes_recorded,
    "epoch_minutes": glucose.epoch_minutes,
    "foods_of_patient": _with(nutrition.foods_of_patient, "Red", "Ring"),
    "eda_without_min": cardio.eda_without_min,
    "spinach_time": _with(nutrition.word_time, "widget"),
    "spinach_mode": _with(nutrition.word_mode, "widget"),
    "hrv_class": cardio.hrv_class,
    "full_name_an": _with(demographics.full_name_matching, "in"),
    "hba1c_by_gender": demographics.hba1c_by_gender,
    "fiber_share": nutrition.fiber_share,
    "corr_eda_hr": cardio.corr_eda_hr,
    "corr_eda_hr_exact": _with(cardio.corr_eda_hr, None),
    "out_of_range_top": glucose.out_of_range_top,
    "min_glucose_on": _with(glucose.min_glucose_on, "2024-01-13"),
    "hr_daily_high": cardio.hr_daily_high,
    "hr_best_day": cardio.hr_best_day,
    "glucose_summary": glucose.glucose_summary,
    "glucose_daily": glucose.glucose_daily,
    "hrv_buckets": cardio.hrv_buckets,
    "hrv_category": cardio.hrv_category,
    "corr_hrv_eda": cardio.corr_hrv_eda,
    "hypo_patients": _aged(glucose.hypo_patients),
    "hypo_severe": _aged(glucose.hypo_severe),
    "ibi_datepart": cardio.ibi_datepart,
    "sugar_patients": nutrition.sugar_patients,
    "birthdays_month": _aged(demographics.birthdays_month),
    "event_types": events.event_types,
    "diabetic_stress": overview.diabetic_stress,
    "diabetic_stress_hrv": overview.diabetic_stress_measures,
    "diabetic_stress_patients": overview.diabetic_stress_patients,
    "food_at_reading": _with(nutrition.food_at_reading, minutes=60),
    "food_at_reading_exact": _food_at_reading_exact,
    "food_at_peak": _with(nutrition.food_at_peak, minutes=60),
    "long_names": _with(demographics.long_names, 4),
    "title_foods": _with(nutrition.title_foods, "et"),
    "birthday_week": overview.birthday_week,
    "banana_breakfast": _with(nutrition.breakfast_patients, "ANVIL"),
    "age_of": _aged(demographics.age_of, patientid=5),
    "least_control": glucose.least_control,
    "patient_events": events.patient_events,
    "eda_40_50_rows": cardio.eda_between_rows,
    "eda_40_50_max": cardio.eda_between_max,
    "incident_counts": glucose.incident_counts,
    "ibi_variance": cardio.ibi_variance,
    "patient_overview": overview.patient_overview,
    "patient_overview_daily": overview.patient_overview_daily,
    "biomarkers": _biomarkers,
    "lunch_calories": _with(nutrition.lunch_calories, "2024-01-24"),
    "hours_recorded_int": glucose.hours_recorded_int,
    "hours_span": glucose.hours_span,
    "readings_of": _with(glucose.readings_of, 1),
    "patient_string": _aged(glucose.patient_string),
    "mean_age_months": _aged(demographics.mean_age_months),
    "mean_age": _aged(demographics.mean_age),
    "females_under": _aged(demographics.females_under),
    "event_counts": events.event_counts,
    "foods_egv": nutrition.foods_of_event,
    "health_rank": overview.health_rank,
    "sugar_alerts": lambda t: sugar_alerts(t.foodlog),
    "prediabetic_high_hr": cardio.prediabetic_high_hr,
    "tachy_high_glucose": overview.tachy_high_glucose,
    "hypo_counts": glucose.hypo_counts,
    "hypo_daily": glucose.hypo_daily,
    "daily_calories": nutrition.daily_calories,
    "below_range_top": glucose.below_range_top,
    "low_hr_patients": cardio.low_hr_patients,
    "hr_age_gender": _aged(cardio.hr_age_gender),
    "eda_buckets": cardio.eda_buckets,
    "eda_buckets_auto": cardio.eda_buckets_auto,
    "exercise_hr": events.exercise_hr,
    "hr_stddev": cardio.hr_stddev,
    "event_id_details": _with(events.event_id_details, 4),
    "tachycardia": cardio.tachycardia,
    "daily_signal_rollup": lambda t: rollups.daily_signal_rollup(t.raw_signal),
    "daily_hr_rollup": lambda t: rollups.daily_hr_rollup(t.raw_signal),
    "ibi_runs": lambda t: rollups.ibi_runs(t.raw_signal),
    "rmssd_daily": lambda t: rollups.rmssd_daily(t.raw_signal).drop("kept_from"),
    "glucose_dense_rank_dates": _with(glucose.glucose_dense_rank, true_date=True),
    "eda_day_leader_dates": _with(cardio.eda_day_leader, true_date=True),
    "hr_daily_high_dates": _with(cardio.hr_daily_high, true_date=True),
    "fiber_share_dates": _with(nutrition.fiber_share, true_date=True),
    "fiber_days": nutrition.fiber_days,
    "signal_week_quantiles": _week_quantiles,
    "eda_from_raw": lambda t: rollups.eda_from_raw(t.patient_signal),
    "hr_from_raw": lambda t: rollups.hr_from_raw(t.patient_signal),
    # A patient has few events a day, so a run may pause for longer.
    "ibi_from_raw": lambda t: rollups.ibi_from_raw(t.patient_signal, gap_seconds=21600),
    "bvp_from_raw": lambda t: rollups.bvp_from_raw(t.patient_signal),
    "hrv_from_raw": _hrv_from_raw,
    "foodlog_append": _foodlog_append,
    "duplicate_keys": lambda t: duplicate_keys(t.foodlog, "patientid", "datetime"),
    "orphan_rows": _orphan_days,
    "orphan_rows_filtered": _orphan_days_filtered,
}


def _job_query(job: Job) -> Query:
    return lambda spark, sf_dir: comparable(job(fixture_tables(spark, sf_dir)))


def _sql_query(sql: str) -> Query:
    """A statement over the registered views and functions."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        fixture_tables(spark, sf_dir).register_views()
        register_sql_functions(spark)
        return comparable(spark.sql(sql))

    return run


def _sugar_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run the meal stream to its end, in several micro-batches, and return the warnings."""

    def scan(name: str) -> DataFrame:
        return spark.read.schema(driver_schema(name)).parquet(f"{sf_dir}/{name}.parquet")

    folder = new_folder(spark, "sugar-stream")
    # The table is one file or folder; the stream reads it in parts.
    scan("lineitem").repartition(4).write.parquet(f"{folder}/lineitem")
    lines = (
        spark.readStream.schema(driver_schema("lineitem"))
        .option("maxFilesPerTrigger", 2)
        .parquet(f"{folder}/lineitem")
    )
    query = start_sugar_stream(foodlog(lines, scan("orders"), scan("part")), folder)
    query.awaitTermination()
    return comparable(spark.read.parquet(f"{folder}/alerts").drop("query", "batch"))


def _beat_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beats that arrive in shuffled lots; the table after the last one."""
    folder = new_folder(spark, "beat-stream")
    beats = fixture_tables(spark, sf_dir).patient_signal
    beats.repartition(4, F.xxhash64("seq")).write.parquet(f"{folder}/arriving")
    arriving = (
        spark.readStream.schema(beats.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/arriving")
    )
    start_beat_stream(arriving, folder, gap_seconds=21600).awaitTermination()
    return comparable(latest_ibi(spark, folder).drop("day", "steps"))


# Sensor files that Spark writes: a folder per wristband and sensor.
_FILES = (r"/patient=(?<patient>\d+)/sensor=(?<sensor>[a-z]+)/[^/]*$",)
_WRISTBANDS = 8


def _sensor_store(spark: SparkSession, sf_dir: str) -> SignalStore:
    """Events as sensor files that arrive in two lots, some lines broken, taken in by two runs."""
    folder = new_folder(spark, "sensor-files")
    events = spark.read.schema(driver_schema("events")).parquet(f"{sf_dir}/events.parquet")
    value = F.when(F.col("event_id") % 50 == 3, "n/a").otherwise(F.col("value").cast("string"))
    lines = events.select(
        (F.col("user_id") % _WRISTBANDS).alias("patient"),
        F.col("event_type").alias("sensor"),
        (F.col("event_id") % 3 == 0).alias("late"),
        F.concat_ws(",", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), value).alias("line"),
    )
    store = SignalStore(spark, f"{folder}/store", _FILES)
    for lot in (False, True):
        arriving = lines.where(F.col("late") == lot).drop("late").repartition("patient", "sensor")
        arriving.write.mode("append").partitionBy("patient", "sensor").text(f"{folder}/raw")
        store.take_in(f"{folder}/raw", f"lot-{lot}", most_faulty=0.05)
    return store


def _signal_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(_sensor_store(spark, sf_dir).daily())


def _signal_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faulty lines per sensor, and their texts."""
    sensor = F.upper(F.regexp_extract("file", r"/sensor=([a-z]+)/", 1))
    found = _sensor_store(spark, sf_dir).quarantine()
    return found.select(sensor.alias("sensor"), "fault", "text")


def _twice_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table after an append that was repeated."""
    folder = new_folder(spark, "foodlog")
    foodlog = fixture_tables(spark, sf_dir).foodlog
    write_run(foodlog, folder, "first")
    pie = spark.sql("SELECT 1 AS patientid, 'pie' AS logged_food, 32 AS sugar")
    for _ in range(2):
        append_rows(pie, foodlog, folder, run="pie")
    return comparable(read_table(spark, folder, "foodlog"))


def _backfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IBI stored by month without a date, and with one from the second month half on."""
    folder = new_folder(spark, "ibi")
    ibi = fixture_tables(spark, sf_dir).ibi
    month = F.date_trunc("month", "datestamp").cast("date").alias("month")
    old = ibi.where(F.dayofmonth("datestamp") < 16).select("*", month)
    dated = ibi.where(F.dayofmonth("datestamp") >= 16).select("*", F.to_date("datestamp").alias("datepart"), month)
    old.write.partitionBy("month").parquet(folder)
    dated.write.mode("append").partitionBy("month").parquet(folder)
    backfill(spark, folder, old.schema, "datepart", F.to_date("datestamp"), "month")
    return comparable(spark.read.schema(dated.schema).parquet(folder).drop("month"))


def _bucketed_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overview of tables that are stored by patient."""
    tables = fixture_tables(spark, sf_dir)
    stored = Tables(**{name: getattr(tables, name) for name in SCHEMAS})
    save_bucketed(stored, 8, "bucketed_", new_folder(spark, "bucketed"))
    return comparable(overview.patient_overview(Tables.from_catalog(spark, "bucketed_")))


def _kept_view(name: str) -> Query:
    """A view of the catalog over the partials of two runs; the second brings late rows of every day."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = fixture_tables(spark, sf_dir)
        views = MaintainedViews(spark, new_folder(spark, "views"))
        for late in (False, True):

            def part(table: str, late: bool = late) -> DataFrame:
                rows = getattr(tables, table)
                return rows.where((F.pmod(F.xxhash64(*rows.columns), F.lit(3)) == 0) == late)

            lots = {table: part(table) for table in ("dexcom", "eda", "hr", "ibi", "demographics")}
            views.take_in(Tables(**lots), f"lot-{late}")
        views.create("kept_")
        return comparable(spark.table(f"kept_{name}"))

    return run


QUERIES: dict[str, Query] = {
    **{name: _job_query(job) for name, job in JOBS.items()},
    "sugar_alerts_stream": _sugar_stream,
    "ibi_from_late_beats": _beat_stream,
    "foodlog_append_twice": _twice_appended,
    "ibi_backfilled": _backfilled,
    "patient_overview_bucketed": _bucketed_overview,
    "demo_stored": _kept_view("demo"),
    "patient_overview_stored": _kept_view("patient_overview"),
    "signal_days": _signal_days,
    "signal_faults": _signal_faults,
    "min_glucose_on_sql": _sql_query("SELECT * FROM retrieve_min_glucose(DATE'2024-01-13')"),
    "age_of_sql": _sql_query(
        f"SELECT patientid, age_in_years(dob, DATE'{AS_OF}') AS age FROM demographics"
    ),
    "retrieve_age_sql": _sql_query(f"SELECT * FROM retrieve_age(5, DATE'{AS_OF}')"),
    "ages_at_meals_sql": _sql_query(
        """SELECT patientid, day, retrieve_age(patientid, day) AS age
        FROM (SELECT DISTINCT patientid, to_date(datetime) AS day FROM foodlog)"""
    ),
    "min_glucose_by_day_sql": _sql_query(
        """SELECT day, patient_id, min_glucose
        FROM (SELECT DISTINCT datestamp AS day FROM eda), LATERAL retrieve_min_glucose(day)"""
    ),
}
