"""Warnings for new food with much sugar, as a batch and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from biotrace.streaming.checkpoints import filled, query_id

ALERT_COLUMNS = ("patientid", "logged_food", "sugar", "message")


def _message() -> Column:
    # Fixed value: wording of the warning.
    return F.concat(
        F.lit("HIGH sugar content ("),
        F.col("sugar").cast("string"),
        F.lit(") detected for food : "),
        F.coalesce("logged_food", F.lit("<NULL>")),
    )


def sugar_alerts(foodlog: DataFrame, above: float = 20) -> DataFrame:
    """Rows above the level with their warning; works on a batch or a stream."""
    return (
        foodlog.where(F.col("sugar") > above)
        .withColumn("message", _message())
        .select(*ALERT_COLUMNS)
    )


def start_sugar_stream(
    foodlog: DataFrame,
    folder: str,
    above: float = 20,
    every: str | None = None,
) -> StreamingQuery:
    """Store all new rows and the warnings for them below one shared folder.

    ``folder/foodlog`` and ``folder/alerts`` get a partition per query and micro-batch, and
    ``folder/checkpoint`` the progress. A batch that is replayed after a failure replaces
    what it wrote, so nothing doubles; a lost checkpoint over filled output is an error, as
    its batches would be numbered and stored anew. The source limits a micro-batch by its
    own options, such as ``maxFilesPerTrigger``. ``every`` (as in "1 minute") keeps the
    stream running; without it the stream ends when the input is used up.
    """
    spark = foodlog.sparkSession
    foodlog_path, alerts_path, checkpoint = (
        f"{folder.rstrip('/')}/{name}" for name in ("foodlog", "alerts", "checkpoint")
    )
    if query_id(spark, checkpoint) is None and filled(spark, foodlog_path):
        raise ValueError(f"{foodlog_path} holds meals but {checkpoint} is new")

    def store(batch: DataFrame, batch_id: int) -> None:
        place = f"query={query_id(batch.sparkSession, checkpoint)}/batch={batch_id}"
        stored = f"{foodlog_path}/{place}"
        batch.write.mode("overwrite").parquet(stored)
        # The warnings read what was stored, so the batch is computed only once.
        kept = batch.sparkSession.read.schema(batch.schema).parquet(stored)
        sugar_alerts(kept, above).write.mode("overwrite").parquet(f"{alerts_path}/{place}")

    writer = foodlog.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    if every is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=every).start()
