"""File listings and the subject registry built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalgrid import fixed
from vocalgrid.functions import columns as C


def file_listing(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """Files below a folder that match a glob, sorted by path. Contents are never read."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", str(recursive).lower())
        .load(folder)
    )
    return files.select("path", "length", "modificationTime").orderBy("path")


def split_path(listing: DataFrame, path: str, root: str = "") -> DataFrame:
    """subject (first folder below the root) and rel (the rest) for each path."""
    below = F.regexp_replace(F.col(path), F.lit("^" + root), F.lit("")) if root else F.col(path)
    cut = F.regexp_extract(below, r"^/?([^/]+)/(.+)$", 1)
    return listing.select(
        cut.alias("subject"), F.regexp_extract(below, r"^/?([^/]+)/(.+)$", 2).alias("rel")
    ).where(F.col("subject") != "")


def corpus_registry(listing: DataFrame) -> DataFrame:
    """One row per subject with the preferred image location and metadata file.

    ``listing`` holds subject and rel. Each file gets the rank of the location it proves, and the
    least rank per subject wins: one aggregation, combined before the shuffle. Subjects without
    images, hidden folders and folders that are never subjects are left out.
    """
    rel = F.col("rel")
    rank = F.coalesce(*[F.when(rel.rlike(p), F.lit(i)) for i, (p, _, _) in enumerate(fixed.IMAGE_LOCATIONS)])
    meta = F.coalesce(*[F.when(rel == name, F.lit(i)) for i, name in enumerate(fixed.METADATA_FILES)])
    visible = listing.where(
        ~F.col("subject").startswith(".") & ~F.col("subject").isin(*fixed.IGNORED_DIRECTORIES)
    )
    best = visible.groupBy("subject").agg(F.min(rank).alias("_rank"), F.min(meta).alias("_meta"))
    folder = F.lit(None).cast("string")
    kind = F.lit(None).cast("string")
    for i, (_, place, form) in enumerate(fixed.IMAGE_LOCATIONS):
        path = F.concat_ws("/", F.col("subject"), F.lit(place)) if place else F.col("subject")
        folder = F.when(F.col("_rank") == i, path).otherwise(folder)
        kind = F.when(F.col("_rank") == i, F.lit(form)).otherwise(kind)
    meta_path = F.lit(None).cast("string")
    for i, name in enumerate(fixed.METADATA_FILES):
        meta_path = F.when(F.col("_meta") == i, F.concat_ws("/", F.col("subject"), F.lit(name))).otherwise(meta_path)
    found = best.where(F.col("_rank").isNotNull()).select(
        F.col("subject").alias("subject_id"), folder.alias("mri_path"), kind.alias("mri_format"), meta_path.alias("metadata_path")
    )
    audio = F.when(F.col("mri_format") == "video_dir", F.col("mri_path"))
    return found.select(
        "subject_id", "mri_path", "mri_format", audio.alias("audio_path"), F.lit(True).alias("audio_embedded"), "metadata_path"
    )


def with_metadata(registry: DataFrame, texts: DataFrame) -> DataFrame:
    """Add ``directory``, the parsed ``metadata`` map and ``fps`` to the registry; ``texts`` holds path and text, one per path.

    A subject without a readable text has a null map and the default rate.
    """
    known = texts.select(F.col("path").alias("metadata_path"), F.col("text").alias("_text"))
    parsed = F.from_json("_text", "map<string,string>")
    return registry.join(known, "metadata_path", "left").select(
        *registry.columns, F.col("subject_id").alias("directory"), parsed.alias("metadata"), C.fps_fallback(F.col("_text")).alias("fps")
    )
