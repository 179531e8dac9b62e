"""The corpus pipeline: five operators in a row, each on what the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder
and gives the file to the next stage, so lineage is cut there and a lost executor repeats one stage at most.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vocalgrid.llm import decontaminate, jaccard_join, piece_codec, quality, toxicity
from vocalgrid.llm.common import bounded_batches, table
from vocalgrid.llm.vocabulary import vocabulary
from vocalgrid.session import new_location


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: rejected documents go; lines above the limit go from the others."""
    bounded_batches(spark)
    return quality.quality_filtered(docs)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents scored as toxic go."""
    return toxicity.filtered(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one document of each class stays."""
    bounded_batches(spark)
    return jaccard_join.deduplicated(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that hold a benchmark passage go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the piece ids of every document that is left."""
    bounded_batches(spark)
    return piece_codec.encoded(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic_documents),
    ("jaccard_join", near_copies),
    ("decontamination", benchmark_leaks),
    ("sentencepiece", pieces),
]

# Trained weights and merge order cannot be put in SQL; tests hold every stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        place = new_location(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return docs
