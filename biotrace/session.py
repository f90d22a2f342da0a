"""Session settings the jobs are tuned for."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

# Adaptive execution sizes the reduce side at run time, so the start value of
# shuffle.partitions only has to be high enough: 128 MB a partition after
# coalescing. Skewed joins are split even when that costs one more shuffle.
CLUSTER_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.shuffle.partitions": "8000",
    # Call sites of column expressions, collected for error messages, slow down
    # the building of a plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cpus: int = 8, **conf: str) -> SparkSession:
    """One-JVM session for tests and the bench."""
    settings = {
        **CLUSTER_CONF,
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("biotrace")
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where it is unset, a session in one JVM gets a folder of its own; on a cluster that is an
    error, as each machine would write to its own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = f"file://{tempfile.mkdtemp(prefix='biotrace-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_RUN: ContextVar[str | None] = ContextVar("run", default=None)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder of this run, or else below the shared folder."""
    return f"{_RUN.get() or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """Put the intermediate tables of what runs inside into one folder, and remove it at the end.

    Results must be stored or collected inside, as they read these tables.
    """
    root = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    token = _RUN.set(root)
    try:
        yield root
    finally:
        _RUN.reset(token)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
