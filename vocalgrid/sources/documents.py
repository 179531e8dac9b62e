"""Nested JSON: documents per row, and batch manifests flattened to utterance rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalgrid import scale

MANIFEST_SCHEMA = """
    total_subjects INT, total_utterances INT, processed INT, failed INT,
    subjects ARRAY<STRUCT<
      subject_id STRING, total_utterances INT, processed INT, failed INT,
      utterances ARRAY<STRUCT<utterance_name STRING, hdf5_path STRING, metadata_path STRING,
                              alignment_valid BOOLEAN, correlation DOUBLE>>,
      failed_utterances ARRAY<STRUCT<utterance_name STRING, error STRING>>>>
"""


def to_documents(df: DataFrame, keys: Sequence[str], fields: Sequence[str], out: str = "doc") -> DataFrame:
    """One JSON object per row."""
    return df.select(*keys, F.to_json(F.struct(*fields)).alias(out))


def from_documents(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Parse JSON texts against a declared schema; the parsed fields replace the text."""
    return df.withColumn("_d", F.from_json(column, schema)).select(
        *[c for c in df.columns if c != column], "_d.*"
    )


def write_documents(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest files as nested rows, schema declared, never inferred."""
    return spark.read.schema(MANIFEST_SCHEMA).option("multiLine", "true").json(path)


def explode_manifest(manifest: DataFrame, utterances: str = "utterances") -> DataFrame:
    """Nested manifests to one row per utterance; subjects without utterances give none."""
    subjects = manifest.select(F.explode("subjects").alias("s"))
    return subjects.select("s.subject_id", F.explode(F.col(f"s.{utterances}")).alias("u")).select("subject_id", "u.*")


def nest_manifest(
    df: DataFrame, subject: str, order: str, fields: Sequence[Column], per_document: int = 500
) -> DataFrame:
    """Utterance rows to manifest rows of one subject each; big subjects take several rows.

    Rows of a subject are dealt to parts by a hash of their name, so that no row of the result
    gathers an unbounded list.
    """
    counts = df.groupBy(subject).agg(F.count(F.lit(1)).alias("_n"))
    sized = scale.attach(df, counts, [subject], [order])
    parts = F.ceil(F.col("_n") / per_document)
    dealt = sized.withColumn("_part", F.pmod(F.xxhash64(order), parts))
    entry = F.struct(*fields)
    nested = dealt.groupBy(subject, "_part").agg(F.array_sort(F.collect_list(entry)).alias("utterances"))
    one = F.struct(F.col(subject).cast("string").alias("subject_id"), "utterances")
    return nested.select(F.array(one).alias("subjects"))
