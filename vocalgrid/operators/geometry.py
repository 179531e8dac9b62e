"""The geometric parameters of label masks, one set of 14 per frame.

``geometric_features`` is the one to use: a frame is one row, so an Arrow kernel computes its
parameters in the task that reads it and nothing is shuffled. ``geometric_features_sql`` is the same
in relational form; it explodes every pixel and measured over ten times slower on 84 x 84 masks, so
it serves as the check and for sessions without Python workers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocalgrid import fixed
from vocalgrid.functions import columns as C
from vocalgrid.functions import kernels
from vocalgrid.functions.arrow import batch_kernel


def geometric_features(
    df: DataFrame, keys: Sequence[str], mask: str, height: int, width: int, clip: bool = True
) -> DataFrame:
    """The 14 parameters in their fixed order, scaled by the frame size; absent classes give 0."""
    run = batch_kernel(
        lambda rows: kernels.mask_geometry(rows.reshape(-1, height, width), fixed.TONGUE, fixed.JAW, fixed.LIPS)
    )
    value = C.clip01 if clip else (lambda c: c)
    held = df.select(*keys, run(F.col(mask)).alias("_g"))
    return held.select(*keys, *[value(F.col("_g")[i]).alias(n) for i, n in enumerate(fixed.GEOMETRIC_FEATURES)])


def row_profile(df: DataFrame, keys: Sequence[str], mask: str, width: int) -> DataFrame:
    """Per frame and image row: pixels of each class, of any class, and the tongue's x statistics."""
    cells = df.select(*keys, F.posexplode(mask).alias("_i", "cls"))
    y = F.floor(F.col("_i") / width).cast("int").alias("y")
    x = (F.col("_i") % width).cast("int")
    tongue = F.col("cls") == fixed.TONGUE
    return cells.groupBy(*keys, y).agg(
        F.count_if(tongue).alias("n_tongue"),
        F.count_if(F.col("cls") == fixed.JAW).alias("n_jaw"),
        F.count_if(F.col("cls") == fixed.LIPS).alias("n_lips"),
        F.count_if(F.col("cls") > 0).alias("n_any"),
        F.sum(F.when(tongue, x)).alias("sum_x"),
        F.min(F.when(tongue, x)).alias("min_x"),
        F.max(F.when(tongue, x)).alias("max_x"),
    )


def _where(name: str, value: str = "y") -> Column:
    return F.when(F.col(name) > 0, F.col(value))


def _share(total: Column, count: Column) -> Column:
    """total / count, null where the class is absent."""
    return F.when(count > 0, total / count)


def _centroid_y(name: str) -> Column:
    return _share(F.sum(F.col("y") * F.col(name)), F.sum(name))


def _extent_y(name: str) -> Column:
    return F.max(_where(name)) - F.min(_where(name))


def geometric_features_sql(
    df: DataFrame, keys: Sequence[str], mask: str, height: int, width: int, clip: bool = True
) -> DataFrame:
    """The same from aggregations: pixels fold to one row per (frame, image row), then per frame.

    Dorsum: mean y of the tongue points up to the 20th percentile of y. The percentile lies between
    the points of rank floor(k) and ceil(k), k = 0.2 (n - 1), and below the second one unless they
    share a row, so these are the points of the image rows that begin at or before rank floor(k).
    """
    profile = row_profile(df, keys, mask, width)
    frame = Window.partitionBy(*keys)
    above = frame.orderBy("y").rowsBetween(Window.unboundedPreceding, -1)
    ranked = profile.withColumn("_before", F.coalesce(F.sum("n_tongue").over(above), F.lit(0)))
    ranked = ranked.withColumn("_rank", F.floor((F.sum("n_tongue").over(frame) - 1) * F.lit(0.2)))
    top = (F.col("n_tongue") > 0) & (F.col("_before") <= F.col("_rank"))
    h, w, area = F.lit(float(height)), F.lit(float(width)), F.lit(float(height * width))
    folded = ranked.groupBy(*keys).agg(
        (F.sum("n_tongue") / area).alias("tongue_area"),
        (_share(F.sum("sum_x"), F.sum("n_tongue")) / w).alias("tongue_centroid_x"),
        (_centroid_y("n_tongue") / h).alias("tongue_centroid_y"),
        (F.min(_where("n_tongue")) / h).alias("tongue_tip_y"),
        (_share(F.sum(F.when(top, F.col("y") * F.col("n_tongue"))), F.sum(F.when(top, F.col("n_tongue")))) / h).alias(
            "tongue_dorsum_height"
        ),
        ((F.max("max_x") - F.min("min_x")) / w).alias("tongue_width"),
        (F.sum("n_jaw") / area).alias("jaw_area"),
        (_centroid_y("n_jaw") / h).alias("jaw_centroid_y"),
        (_extent_y("n_jaw") / h).alias("jaw_opening"),
        (F.sum("n_lips") / area).alias("lip_area"),
        (_centroid_y("n_lips") / h).alias("lip_centroid_y"),
        (_extent_y("n_lips") / h).alias("lip_aperture"),
        # Narrowest row, the upper one on ties, as one number: width first, then y.
        F.min(F.when(F.col("n_any") > 0, F.col("n_any") * height + F.col("y"))).alias("_narrowest"),
    )
    full = folded.withColumn("constriction_degree", F.floor(F.col("_narrowest") / height) / w)
    full = full.withColumn("constriction_location_y", F.col("_narrowest") % height / h)
    value = C.clip01 if clip else (lambda c: c)
    named = [value(F.coalesce(F.col(n), F.lit(0.0))).alias(n) for n in fixed.GEOMETRIC_FEATURES]
    return full.select(*keys, *named)


def feature_group(features: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    """The columns of one articulator: ``tongue``, ``jaw``, ``lip`` or ``constriction``."""
    return features.select(*keys, *[n for n in fixed.GEOMETRIC_FEATURES if n.startswith(prefix)])
