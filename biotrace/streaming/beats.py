"""Kept beats of each patient-day from a stream whose samples arrive late and in any order.

The state of a patient-day is the first and last time of its slots, a row per slot and
micro-batch. Rows of all batches merge by their least and greatest times, so a late beat can
close a gap between two runs, and move the kept minutes to an earlier run. Only the
patient-days that a batch touches are worked out again, and only their beats inside the kept
minutes are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from biotrace.operators import rollups
from biotrace.plans.keys import with_key_in
from biotrace.streaming.checkpoints import filled, query_id

_KEY = ["series", "day"]


def start_beat_stream(
    samples: DataFrame,
    folder: str,
    gap_seconds: float = 3600,
    minutes: int = 30,
    every: str | None = None,
) -> StreamingQuery:
    """Keep table ``ibi`` of raw samples (patientid, ts, seq, value) up to date.

    ``folder/beats``, ``folder/slots`` and ``folder/ibi`` get a partition per query,
    micro-batch and day; ``latest_ibi`` reads the newest row of each patient-day. A replayed
    batch replaces what it wrote. Without ``every`` the stream ends with its input. A lost
    checkpoint over filled output is an error.
    """
    spark = samples.sparkSession
    beats, slots, ibi, checkpoint = (
        f"{folder.rstrip('/')}/{name}" for name in ("beats", "slots", "ibi", "checkpoint")
    )
    if query_id(spark, checkpoint) is None and filled(spark, beats):
        raise ValueError(f"{beats} holds beats but {checkpoint} is new")

    def store(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        query = query_id(session, checkpoint)
        place = f"query={query}/batch={batch_id}"

        def write(df: DataFrame, path: str) -> DataFrame:
            """Store a part of this batch; all of this query's parts up to now."""
            df.write.mode("overwrite").partitionBy("day").parquet(f"{path}/{place}")
            return _upto(session, path, df, query, batch_id)

        raw = batch.withColumnRenamed("patientid", "series").withColumn("day", F.to_date("ts"))
        every_beat = write(raw, beats)
        fresh = rollups.gap_slots(every_beat.where(F.col("batch") == batch_id), gap_seconds)
        every_slot = write(fresh, slots)
        touched = every_slot.where(F.col("batch") == batch_id).select(*_KEY).distinct()
        # The days of one batch, to prune the folders of earlier ones.
        days = F.col("day").isin([row.day for row in touched.select("day").distinct().collect()])
        mine = with_key_in(every_slot.where(days), touched, *_KEY)
        runs = rollups.runs_of_slots(rollups.merged_slots(mine), gap_seconds)
        window = rollups.window_of_runs(runs, minutes)
        kept = rollups.samples_in(every_beat.where(days), window)
        write(rollups.rmssd_of(kept), ibi)

    writer = samples.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    if every is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=every).start()


def _upto(spark: SparkSession, path: str, like: DataFrame, query: str, batch_id: int) -> DataFrame:
    stored = spark.read.schema(like.schema.add("query", "string").add("batch", "long")).parquet(path)
    return stored.where((F.col("query") == query) & (F.col("batch") <= batch_id))


def latest_ibi(spark: SparkSession, folder: str) -> DataFrame:
    """Table ``ibi`` as it stands, with the day and number of steps of each row."""
    newest = F.struct(*[_named(c) for c in ("kept_from", "rmssd", "mean_value", "steps")])
    stored = spark.read.parquet(f"{folder.rstrip('/')}/ibi")
    return (
        stored.groupBy(F.col("series").alias("patientid"), "day")
        .agg(F.max_by(newest, "batch").alias("row"))
        .select(
            "patientid",
            "day",
            F.col("row.kept_from").alias("datestamp"),
            F.col("row.rmssd").alias("rmssd_ms"),
            F.col("row.mean_value").alias("mean_ibi_ms"),
            F.col("row.steps").alias("steps"),
        )
    )


def _named(name: str) -> Column:
    return F.col(name).alias(name)
