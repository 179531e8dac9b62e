"""Progress of a running batch as utterance results arrive, with Structured Streaming.

The stream itself holds no state: each micro-batch sums its own rows per window and writes the sums below its number. Counts
add up, so a row that comes a year late is one more sum of a window long past, and nothing has to be kept open or given up. Every
``COMPACT`` triggers the sums are folded into one row per window, so the report reads a bounded number of folders
however long the stream runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalgrid.operators.summaries import with_eta
from vocalgrid.session import new_location

COMPACT = 16


def windowed_progress(rows: DataFrame, ts: str, width: str, done: Column, expected: Column, by: Sequence[str] = ()) -> DataFrame:
    """Done and expected counts of some rows per tumbling window."""
    timed = rows.withColumn("_ts", F.col(ts).cast("timestamp"))
    return timed.groupBy(F.window("_ts", width)["start"].alias("window_start"), *by).agg(
        F.sum(expected).cast("long").alias("expected"), F.sum(done).cast("long").alias("done")
    )


class WindowSums:
    """Sums per window in a folder: one folder a trigger, folded now and then. A trigger that is run again replaces what it wrote."""

    def __init__(self, spark: SparkSession, place: str, by: Sequence[str] = (), compact: int = COMPACT) -> None:
        self.spark, self.place, self.by, self.compact = spark, place, list(by), compact
        self.folders: list[str] = []

    def add(self, sums: DataFrame, number: int) -> None:
        folder = f"{self.place}/trigger-{number}"
        sums.write.mode("overwrite").parquet(folder)
        if folder not in self.folders:
            self.folders.append(folder)
        if len(self.folders) > self.compact:
            folded = f"{self.place}/until-{number}"
            self.totals().write.mode("overwrite").parquet(folded)
            self.folders = [folded]

    def totals(self) -> DataFrame | None:
        """One row per window, or None before the first trigger."""
        if not self.folders:
            return None
        parts = self.spark.read.parquet(*self.folders)
        return parts.groupBy("window_start", *self.by).agg(F.sum("expected").cast("long").alias("expected"), F.sum("done").cast("long").alias("done"))


def run_progress(
    spark: SparkSession,
    path: str,
    schema,
    ts: str,
    width: str,
    done: Column,
    expected: Column,
    by: Sequence[str] = (),
    source_format: str = "parquet",
    max_files: int | None = None,
    pattern: str = "*",
    compact: int = COMPACT,
) -> DataFrame:
    """Work through all files there are and return the report: counts, percent and remaining time per window.

    The stream's checkpoint and the sums live in the shared folder; a trigger that failed is run again with the same
    rows and overwrites its own sums, so each row counts once.
    """
    reader = spark.readStream.format(source_format).schema(schema).option("pathGlobFilter", pattern)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    sums = WindowSums(spark, new_location(spark, "progress"), by, compact)

    def keep(batch: DataFrame, number: int) -> None:
        sums.add(windowed_progress(batch, ts, width, done, expected, by), number)

    query = (
        reader.load(path)
        .writeStream.foreachBatch(keep)
        .option("checkpointLocation", new_location(spark, "progress-state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    totals = sums.totals()
    if totals is None:
        totals = windowed_progress(spark.createDataFrame([], schema), ts, width, done, expected, by)
    return with_eta(totals)
