"""Parquet, text and CSV stores: utterance containers, feature files, split lists, shards, logs.

Writers range-partition by folder and order first, so a folder is written by as many tasks as its
size asks for, a large one by several, and files come out sorted for row-group pruning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS_SCHEMA = """
    epoch INT, `lr-AdamW` DOUBLE, step INT,
    `train/acc` DOUBLE, `train/dice` DOUBLE, `train/iou` DOUBLE, `train/loss` DOUBLE,
    `val/acc` DOUBLE, `val/dice` DOUBLE, `val/iou` DOUBLE, `val/loss` DOUBLE
"""


def write_utterances(
    df: DataFrame, path: str, partition: Sequence[str], order: Sequence[str], compression: str = "gzip"
) -> None:
    ranged = df.repartitionByRange(*partition, *order).sortWithinPartitions(*partition, *order)
    ranged.write.mode("overwrite").option("compression", compression).partitionBy(*partition).parquet(path)


def read_utterances(spark: SparkSession, path: str, keys: Sequence[str] | None = None) -> DataFrame:
    """The stored columns named in ``keys``; unknown ones are skipped, and only these are read."""
    stored = spark.read.parquet(path)
    return stored if keys is None else stored.select(*[k for k in keys if k in stored.columns])


def write_features(df: DataFrame, path: str, kind: str, subject: str, order: Sequence[str]) -> None:
    """Features of one kind, below ``kind=<kind>/subject=<subject>``."""
    held = df.withColumn("kind", F.lit(kind))
    ranged = held.repartitionByRange(subject, *order).sortWithinPartitions(subject, *order)
    ranged.write.mode("append").partitionBy("kind", subject).parquet(path)


def read_features(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One kind with the columns its own files have; other folders are not listed at all."""
    return spark.read.option("basePath", path).parquet(f"{path}/kind={kind}").drop("kind")


def append_manifest(rows: DataFrame, place: str) -> None:
    """Manifest rows of one part of a batch job; once written, its utterances are committed. One job writes at a time."""
    rows.write.mode("append").parquet(f"{place}/manifest")


def read_manifest(spark: SparkSession, place: str, keys: Sequence[str]) -> DataFrame | None:
    """One row per utterance: that of its success, else that of its last attempt; None before the first part was written."""
    try:
        rows = spark.read.parquet(f"{place}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    last = F.max_by(F.struct(*rows.columns), F.struct(F.col("error").isNull(), "attempt")).alias("_last")
    return rows.groupBy(*keys).agg(last).select("_last.*")


def write_split_lists(splits: DataFrame, path: str, name: str) -> None:
    """Sorted text lists, one folder per split."""
    lines = splits.select("split", F.col(name).cast("string").alias("value"))
    ranged = lines.repartitionByRange("split", "value").sortWithinPartitions("split", "value")
    ranged.write.mode("overwrite").partitionBy("split").text(path)


def read_split_lists(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path)
    return lines.select(F.trim("value").alias("name"), "split").where(F.col("name") != "")


def write_shards(assigned: DataFrame, path: str) -> None:
    """The rows of each shard below ``shard=<n>``."""
    ranged = assigned.repartitionByRange("shard", "position").sortWithinPartitions("shard", "position")
    ranged.write.mode("overwrite").partitionBy("shard").parquet(path)


def write_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def read_metrics(spark: SparkSession, path: str, schema: str = METRICS_SCHEMA) -> DataFrame:
    """Sparse training log: training and validation values come on different rows."""
    return spark.read.schema(schema).option("header", "true").csv(path)
