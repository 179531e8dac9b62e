"""The driver tables in the roles the operators expect, as DataFrames and as SQL fragments.

``embeddings`` plays 8x8 frames (label = utterance), ``events`` sampled signals (user = utterance),
``customer``/``orders``/``lineitem`` subject/utterance/frame parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalgrid import scale
from vocalgrid.functions import columns as C

SIDE = 8
PIXELS = SIDE * SIDE
MASK_THRESHOLDS = (-0.1, 0.0, 0.1)
LINE_ORDER = (
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_shipdate",
    "l_returnflag",
    "l_linestatus",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """utt, frame_id (unique), pixels: the per-frame grain, no ranking needed."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("utt"),
        F.col("vec_id").alias("frame_id"),
        F.col("embedding").cast("array<double>").alias("pixels"),
    )


def indexed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with the dense frame_idx inside the utterance, for operators along time."""
    return scale.with_position(frames(spark, sf_dir), ["utt"], ["frame_id"], "frame_idx")


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frames(spark, sf_dir)
    return df.select("utt", "frame_id", C.digitize_frame(F.col("pixels"), MASK_THRESHOLDS).alias("mask"))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """utt, frame_idx, value and the event's other columns."""
    events = table(spark, sf_dir, "events").withColumnRenamed("user_id", "utt")
    return scale.with_position(events, ["utt"], ["ts", "event_id"], "frame_idx")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signal's key, position and value only."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("utt"), "ts", "event_id", "value")
    placed = scale.with_position(events, ["utt"], ["ts", "event_id"], "frame_idx")
    return placed.select("utt", "frame_idx", "value")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per utterance: subject, utt, correlation, offset_seconds, n_frames, status."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_custkey").alias("subject"),
        F.col("o_orderkey").alias("utt"),
        (F.col("o_totalprice") / F.lit(1e6)).alias("correlation"),
        ((F.col("o_orderkey") % 41 - 20) * F.lit(0.5)).alias("offset_seconds"),
        (F.col("o_orderkey") % 3000 + 100).alias("n_frames"),
        F.col("o_orderstatus").alias("status"),
    )


def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame parameters per order with the dense frame_idx."""
    lines = table(spark, sf_dir, "lineitem")
    placed = scale.with_position(lines, ["l_orderkey"], list(LINE_ORDER), "frame_idx")
    return placed.withColumnRenamed("l_orderkey", "utt")


# The same roles in SQL, for the checking side.
FRAMES_SQL = """frames AS (
  SELECT CAST(label AS BIGINT) AS utt, vec_id AS frame_id,
         row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_idx,
         CAST(embedding AS DOUBLE[]) AS pixels
  FROM embeddings)"""

PIXELS_SQL = f"""{FRAMES_SQL},
px AS (
  SELECT utt, frame_id, frame_idx, i // {SIDE} AS y, i % {SIDE} AS x, v
  FROM (SELECT utt, frame_id, frame_idx, unnest(range(0, {PIXELS})) AS i, unnest(pixels) AS v FROM frames))"""

MASK_SQL = f"""{PIXELS_SQL},
mask AS (
  SELECT utt, frame_id, frame_idx, y, x,
         (CASE WHEN v >= -0.1 THEN 1 ELSE 0 END + CASE WHEN v >= 0.0 THEN 1 ELSE 0 END
          + CASE WHEN v >= 0.1 THEN 1 ELSE 0 END) AS cls
  FROM px)"""

SIGNAL_SQL = """signal AS (
  SELECT user_id AS utt, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx,
         value, event_id, event_type, ts, props
  FROM events),
sized AS (SELECT utt, count(*) AS n FROM signal GROUP BY utt)"""

SCORES_SQL = """scores AS (
  SELECT o_custkey AS subject, o_orderkey AS utt, o_totalprice / 1e6 AS correlation,
         (o_orderkey % 41 - 20) * CAST(0.5 AS DOUBLE) AS offset_seconds, o_orderkey % 3000 + 100 AS n_frames,
         o_orderstatus AS status
  FROM orders)"""

TIER_SQL = """CASE WHEN correlation >= 0.4 THEN 'EXCELLENT' WHEN correlation >= 0.3 THEN 'GOOD'
  WHEN correlation >= 0.2 THEN 'MODERATE' WHEN correlation >= 0.1 THEN 'ACCEPTABLE' ELSE 'POOR' END"""

PARAMETERS_SQL = f"""parameters AS (
  SELECT l_orderkey AS utt, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) - 1
         AS frame_idx, * EXCLUDE (l_orderkey)
  FROM lineitem)"""
