"""What the optimizer makes of the jobs."""

from __future__ import annotations

import re
from functools import partial

import pytest
from conftest import TESTDATA

from biotrace.checks.registry import QUERIES
from biotrace.operators import cardio, glucose, nutrition, overview, rollups
from biotrace.sources.fixtures import fixture_tables
from biotrace.sources.sinks import write_table

SF_DIR = f"{TESTDATA}/sf0.001"
EAGER = {
    "sugar_alerts_stream",
    "ibi_from_late_beats",
    "signal_days",
    "signal_faults",
    "foodlog_append_twice",
    "ibi_backfilled",
    "demo_stored",
    "patient_overview_bucketed",
    "patient_overview_stored",
}


def plan_of(df, final: bool = False) -> str:
    if final:
        df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return _without_initial_plans(text) if final else text


def _without_initial_plans(text: str) -> str:
    """What ran; a subquery inside the plan shows its own initial plan too."""
    kept, skipped = [], None
    for line in text.splitlines():
        if skipped is not None and not line[: skipped + 3].strip():
            continue
        start = line.find("+- == Initial Plan ==")
        skipped = start if start >= 0 else None
        if skipped is None:
            kept.append(line)
    return "\n".join(kept)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Tables as files, so that scans can be counted."""
    from biotrace.schema import SCHEMAS, Tables

    root = str(tmp_path_factory.mktemp("tables"))
    fixture = fixture_tables(spark, SF_DIR)
    for name in SCHEMAS:
        write_table(getattr(fixture, name), f"{root}/{name}")
    write_table(fixture.raw_signal, f"{root}/raw_signal")
    tables = Tables.from_directory(spark, root)
    raw = spark.read.parquet(f"{root}/raw_signal")
    return tables, raw


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_cross_join_and_no_python(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    for banned in ("NestedLoop", "Cartesian", "Python", "ArrowEval", "InPandas"):
        assert banned not in plan


@pytest.mark.parametrize(
    ("job", "scans"),
    [
        (glucose.incident_counts, 1),
        (glucose.glucose_rank, 1),
        (glucose.glucose_dense_rank, 1),
        (glucose.glucose_summary, 1),
        (overview.health_rank, 2),
        (overview.patient_overview, 5),
        (overview.patient_overview_daily, 5),
        (cardio.corr_eda_hr, 2),
        (partial(nutrition.food_at_peak, minutes=1440), 2),
    ],
)
def test_each_table_is_scanned_once(stored, job, scans):
    plan = plan_of(job(stored[0]), final=True)
    assert len(re.findall("FileScan", plan)) == scans


def test_signal_rollup_scans_once(stored):
    plan = plan_of(rollups.daily_signal_rollup(stored[1]), final=True)
    assert len(re.findall("FileScan", plan)) == 1


def test_filters_and_columns_reach_the_scan(stored):
    plan = plan_of(glucose.hours_out_of_range(stored[0]))
    assert "PushedFilters: [Or(LessThan(glucose_value_mgdl,55.0),GreaterThan" in plan
    assert "ReadSchema: struct<patientid:bigint,glucose_value_mgdl:double>" in plan


@pytest.mark.parametrize("job", [cardio.eda_day_leader, cardio.hr_best_day])
def test_first_place_is_limited_before_the_shuffle(stored, job):
    assert len(re.findall("WindowGroupLimit", plan_of(job(stored[0])))) == 2


def test_unpartitioned_windows_see_buckets_only(stored):
    """The single-task part of a rank starts from bucket totals."""
    plan = plan_of(glucose.glucose_rank(stored[0]))
    below = [part.lstrip().splitlines()[1:3] for part in plan.split("SinglePartition")[1:]]
    # Split points come from summaries of bounded size.
    windows = [lines for lines in below if "partial_percentile_approx" not in lines[0]]
    assert len(windows) == 1
    assert any("keys=[bucket" in line for line in windows[0])


def test_per_patient_joins_need_no_shuffle_of_their_own(spark, stored):
    """Without broadcasts, aggregates on the patient meet on their own shuffle."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(overview.biomarkers(stored[0]))
        assert len(re.findall("Exchange hashpartitioning", plan)) == 3
        assert len(re.findall("SortMergeJoin", plan)) == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_foods_of_an_event_hold_no_pairs(stored):
    """Only names are made distinct, and a patient's meals are dealt out by more than the patient."""
    plan = plan_of(nutrition.foods_of_event(stored[0]))
    held = [keys for keys in re.findall(r"HashAggregate\(keys=\[([^\]]*)\]", plan) if "logged_food" in keys]
    assert held and not any("patientid" in keys for keys in held)
    assert re.search(r"SortMergeJoin \[patientid#\d+L, _part#\d+L\]", plan)


def test_sorted_meals_keep_their_partitions(spark):
    """The join of lines and orders runs in as many tasks as are set, however few bytes it reads."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(fixture_tables(spark, SF_DIR).foodlog.select("patientid", "datetime"))
        assert "Exchange hashpartitioning(o_orderkey" in plan
        assert "REPARTITION_BY_NUM" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_top_one_does_not_sort_everything(stored):
    plan = plan_of(glucose.out_of_range_top(stored[0]))
    assert "TakeOrderedAndProject" in plan
    assert "rangepartitioning" not in plan


def test_storing_a_daily_report_needs_no_sort(stored):
    assert "rangepartitioning" in plan_of(nutrition.daily_calories(stored[0]))
    plan = plan_of(nutrition.daily_calories(stored[0], ordered=False))
    assert len(re.findall("Exchange", plan)) == 1


@pytest.fixture()
def lookups(spark, stored):
    """Lookup functions over stored tables, with no broadcasts."""
    from biotrace.functions.sql_functions import register_sql_functions

    stored[0].register_views()
    register_sql_functions(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark.sql
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_lookups_of_one_key_filter_the_scan(lookups):
    plan = plan_of(lookups("SELECT * FROM retrieve_age(5, DATE'2024-02-01')"))
    assert "PushedFilters: [IsNotNull(patientid), EqualTo(patientid,5)]" in plan
    assert "Aggregate" not in plan
    plan = plan_of(lookups("SELECT * FROM retrieve_min_glucose(DATE'2024-01-13')"))
    assert "GreaterThanOrEqual(datestamp,2024-01-13T00:00)" in plan
    assert "LessThan(datestamp,2024-01" in plan


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT id, retrieve_age(id, date_add(DATE'2020-01-01', CAST(id % 1500 AS INT))) FROM range(10000)",
        "SELECT id, age FROM range(10000), LATERAL retrieve_age(id, DATE'2024-02-01')",
        "SELECT id, age FROM range(10000) LEFT JOIN LATERAL retrieve_age(id, DATE'2024-02-01')",
        """SELECT id, m.* FROM (SELECT id, date_add(DATE'2020-01-01', CAST(id AS INT)) AS day FROM range(10000)),
        LATERAL retrieve_min_glucose(day) m""",
    ],
)
def test_lookups_of_many_keys_are_joins(lookups, sql):
    plan = plan_of(lookups(sql))
    assert "NestedLoop" not in plan
    assert "Cartesian" not in plan
    assert len(re.findall("SortMergeJoin", plan)) == 1


def test_a_narrow_signal_spreads_over_buckets(spark):
    """Values within one unit, skewed and with a hot one: no bucket holds many distinct values."""
    from pyspark.sql import functions as F

    from biotrace.plans.median import group_profile
    from biotrace.plans.ranking import value_ranks
    from biotrace.plans.splits import with_buckets

    rows = spark.range(40_000).select(
        (F.col("id") % 2).alias("g"),
        F.when(F.col("id") % 3 == 0, 0.125).otherwise(F.pow(F.rand(3), F.lit(6))).alias("x"),
    )
    values = rows.select("x").distinct()
    depth = with_buckets(values, "x", levels=10).groupBy("bucket").count()
    assert depth.count() > 900
    assert with_buckets(values, "x").select("bucket").distinct().count() > 50
    assert depth.agg(F.max("count")).first()[0] < 4 * values.count() / 1024
    order = with_buckets(values, "x", levels=10).groupBy("bucket").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    ends = sorted(tuple(r) for r in order.collect())
    assert all(a[2] < b[1] for a, b in zip(ends, ends[1:], strict=False))
    for dense in (False, True):
        wide = value_ranks(rows, "x", dense=dense, width=1.0)
        assert sorted(wide.collect()) == sorted(value_ranks(rows, "x", dense=dense).collect())
    assert sorted(group_profile(rows, ["g"], "x", 1.0).drop("mean_value").collect()) == sorted(
        group_profile(rows, ["g"], "x").drop("mean_value").collect()
    )
    hard = spark.createDataFrame(
        [(None,), (float("nan"),), (float("inf"),), (float("-inf"),), (0.0,), (5.0,)], "x double"
    )
    found = {repr(r.x): r.bucket for r in with_buckets(hard, "x").collect()}
    assert found["None"] is None
    assert found["-inf"] <= found["0.0"] <= found["5.0"] <= found["inf"] <= found["nan"]
    assert found["0.0"] < found["5.0"]
    assert with_buckets(hard.limit(0), "x").count() == 0
    assert with_buckets(hard.where("x IS NULL"), "x").collect()[0].bucket is None


def test_tables_stored_by_patient_meet_without_a_shuffle(spark, stored, tmp_path):
    from biotrace.schema import Tables
    from biotrace.sources.sinks import save_bucketed

    save_bucketed(stored[0], 4, "by_patient_", str(tmp_path))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = overview.patient_overview(Tables.from_catalog(spark, "by_patient_"))
        plan = plan_of(found)
        assert "Exchange" not in plan
        assert len(re.findall("SortMergeJoin", plan)) == 4
        assert sorted(map(repr, found.collect())) == sorted(
            map(repr, overview.patient_overview(stored[0]).collect())
        )
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in stored[0].names:
            spark.sql(f"DROP TABLE by_patient_{name}")


def test_known_orphans_are_not_shuffled(spark):
    from pyspark.sql import functions as F

    from biotrace.plans.membership import rows_found_in, rows_missing_in, with_hit
    from biotrace.sources.quality import orphan_rows

    # One key holds a third of the children, and has no parent.
    child = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, -7).when(F.col("id") % 101 == 0, None).otherwise(F.col("id")).alias("k"),
        (F.col("id") % 2).alias("part"),
        "id",
    )
    parent = spark.range(0, 30_000, 10).select(F.col("id").alias("k"), (F.col("id") % 4).alias("part"))
    for keys in (["k"], ["k", "part"]):
        exact = orphan_rows(child, parent, *keys).select("id")
        for bits in (64, 2**12, 2**17):
            found = rows_missing_in(child, parent, *keys, bits=bits).select("id")
            assert sorted(found.collect()) == sorted(exact.collect())
        semi = child.join(parent, keys, "left_semi").select("id")
        assert sorted(rows_found_in(child, parent, *keys, bits=2**17).select("id").collect()) == sorted(semi.collect())
        hits = with_hit(child, parent, *keys, bits=2**17).where("hit").count()
        assert semi.count() <= hits <= semi.count() + 300
    assert rows_missing_in(child, parent.limit(0), "k", bits=64).count() == 30_000
    assert rows_missing_in(child.limit(0), parent, "k", bits=64).count() == 0
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # The filter stands between the scan of the children and the only shuffle of theirs.
        plan = plan_of(rows_missing_in(child, parent, "k"))
        shuffled = plan[plan.index("SortMergeJoin") :].split("Exchange hashpartitioning(k#")[1]
        assert "Filter" in shuffled.split("Range")[0]
        assert "getbit" in shuffled.split("Range")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
