"""Daily roll-ups that grow with new sensor files, without reading the old ones again.

Below the root of a store lie

* ``run=<key>/lines`` and ``run=<key>/quarantine``: the lines of one run's files,
* ``values/run=<key>/day=<day>``: how often each value occurs per patient and sensor, a
  partial that adds up over runs,
* ``daily/day=<day>``: the roll-up of each day,
* ``ledger/run=<key>``: the files of each finished run.

A run reads the files that the ledger does not know, adds their partials, and builds the
days these touch anew, from the partials of all runs. The ledger comes last, and only runs
it names are counted: a run that died is repeated under any key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biotrace.plans.median import profile_of_counts
from biotrace.schema import DAY, LONG, REAL, TEXT, struct
from biotrace.sources.landing import load_lines
from biotrace.sources.readers import PATHS

_GROUP = ["patientid", "sensor", "day"]
_VALUES = struct(patientid=LONG, sensor=TEXT, value=REAL, copies=LONG, run=TEXT, day=DAY)
_LEDGER = struct(file=TEXT, length=LONG, run=TEXT)
_DAILY = struct(
    patientid=LONG,
    sensor=TEXT,
    samples=LONG,
    min_value=REAL,
    median_value=REAL,
    max_value=REAL,
    mean_value=REAL,
    day=DAY,
)


def value_counts(samples: DataFrame) -> DataFrame:
    """How often each value of a patient's sensor occurs on a day; NULL values count 0."""
    return (
        samples.withColumn("day", F.to_date("ts"))
        .groupBy(*_GROUP, "value")
        .agg(F.count("value").alias("copies"))
    )


def merged(counts: DataFrame) -> DataFrame:
    """Counts of several runs, added up."""
    return counts.groupBy(*_GROUP, "value").agg(F.sum("copies").alias("copies"))


def daily_profile(counts: DataFrame, width: float | None = None) -> DataFrame:
    """Number, lowest, median, highest and mean value per patient, sensor and day."""
    sizes = counts.groupBy(*_GROUP).agg(F.sum("copies").alias("samples"))
    return profile_of_counts(counts, _GROUP, "value", width).join(sizes, _GROUP).select(*_DAILY.names)


class SignalStore:
    """A store below ``root``; ``patterns`` tell patient and sensor from a file's path."""

    def __init__(self, spark: SparkSession, root: str, patterns: tuple[str, ...] = PATHS, width: float | None = None):
        self.spark, self.root, self.patterns, self.width = spark, root.rstrip("/"), patterns, width

    def _read(self, name: str, schema) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(path):
            return self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
        return self.spark.read.schema(schema).parquet(path.toString())

    def ledger(self) -> DataFrame:
        """(file, length, run) of every file taken in."""
        return self._read("ledger", _LEDGER)

    def quarantine(self) -> DataFrame:
        """(file, line, fault, text) of the faulty lines of all finished runs."""
        parts = [self.spark.read.parquet(f"{self.root}/run={run}/quarantine") for run in self._runs()]
        if not parts:
            empty = {"file": "string", "line": "long", "fault": "string", "text": "string"}
            return self.spark.range(0).select(*[F.lit(None).cast(kind).alias(c) for c, kind in empty.items()])
        return reduce(DataFrame.unionByName, parts)

    def daily(self) -> DataFrame:
        return self._read("daily", _DAILY)

    def _runs(self) -> list[str]:
        return sorted(row.run for row in self.ledger().select("run").distinct().collect())

    def new_files(self, path: str) -> list[str]:
        """Files below a folder that no run has taken in; one that has changed since is an error."""
        listed = (
            self.spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .load(path)
            .select(F.col("path").alias("file"), F.col("length").alias("found"))
        )
        rows = (
            listed.join(self.ledger(), "file", "left")
            .where(F.col("length").isNull() | (F.col("length") != F.col("found")))
            .select("file", "length")
            .collect()
        )
        changed = sorted(row.file for row in rows if row.length is not None)
        if changed:
            raise ValueError(f"files changed after they were taken in: {', '.join(changed[:5])}")
        return sorted(row.file for row in rows)

    def take_in(self, path: str, run: str, most_faulty: float = 0.01, most_files: int | None = None) -> int:
        """Add the new files below a folder under a run's key; how many there were.

        A key that is done adds nothing. ``most_files`` leaves further files to later runs.
        """
        runs = self._runs()
        if run in runs:
            return 0
        files = self.new_files(path)[:most_files]
        if not files:
            return 0
        folder = f"{self.root}/run={run}"
        samples = load_lines(self.spark, files, folder, self.patterns, most_faulty)
        # Hot days are dealt to several tasks.
        counts = value_counts(samples).hint("rebalance", "day")
        counts.write.mode("overwrite").partitionBy("day").parquet(f"{self.root}/values/run={run}")
        self._refresh([*runs, run], run)
        taken = self.spark.read.format("binaryFile").load(files).select(F.col("path").alias("file"), "length")
        taken.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/ledger/run={run}")
        return len(files)

    def rebuild(self) -> None:
        """Build every day anew from the partials."""
        self._refresh(self._runs(), None)

    def _refresh(self, runs: list[str], touched_by: str | None) -> None:
        values = self._read("values", _VALUES)
        chosen = F.col("run").isin(runs)
        if touched_by is not None:
            days = values.where(F.col("run") == touched_by).select("day").distinct().collect()
            chosen &= _one_of("day", [row.day for row in days])
        daily = daily_profile(merged(values.where(chosen)), self.width)
        (
            daily.hint("rebalance", "day")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("day")
            .parquet(f"{self.root}/daily")
        )


def _one_of(name: str, values: list) -> Column:
    """The column is one of the values, NULL among them."""
    known = [v for v in values if v is not None]
    found = F.col(name).isin(known) if known else F.lit(False)
    return found | F.col(name).isNull() if len(known) < len(values) else found
