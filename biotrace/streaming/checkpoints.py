"""What a checkpoint says about the query that owns it."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def query_id(spark: SparkSession, checkpoint: str) -> str | None:
    """The id that Spark keeps in a checkpoint; None for one that was never used."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(checkpoint, "metadata")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    return json.loads(spark.read.text(path.toString()).first()[0])["id"]


def filled(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.exists(path) and len(files.listStatus(path)) > 0
