"""Segmentation scores from pairs of masks: counted inside the row, nothing is exploded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalgrid import fixed
from vocalgrid.functions import columns as C


def dice_iou(df: DataFrame, keys: Sequence[str], predicted: str, target: str, n_classes: int) -> DataFrame:
    """Per frame and class: dice, iou, and the frame's pixel accuracy.

    A class that both masks lack scores 1.
    """
    # Pixels where both agree keep their class, others become -1: overlaps are then plain counts.
    agree = F.zip_with(predicted, target, lambda p, t: F.when(p == t, p).otherwise(-1))
    held = df.withColumn("_agree", agree)
    eps = F.lit(fixed.DICE_EPSILON)
    cells = []
    for c in range(n_classes):
        both, p, t = (C.count_value(F.col(m), c).cast("double") for m in ("_agree", predicted, target))
        cells.append(
            F.struct(
                F.lit(c).cast("long").alias("cls"),
                ((2.0 * both + eps) / (p + t + eps)).alias("dice"),
                ((both + eps) / (p + t - both + eps)).alias("iou"),
            )
        )
    accuracy = F.lit(1.0) - C.count_value(F.col("_agree"), -1) / F.size("_agree")
    rows = held.select(*keys, accuracy.alias("pixel_accuracy"), F.explode(F.array(*cells)).alias("_c"))
    return rows.select(*keys, "_c.cls", "_c.dice", "_c.iou", "pixel_accuracy")


def macro_eval(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean over samples per class (cls set) and the macro means (cls null)."""
    per_class = scores.groupBy("cls").agg(F.avg("dice").alias("dice"), F.avg("iou").alias("iou"))
    per_sample = scores.groupBy(*keys).agg(
        F.avg("dice").alias("dice"), F.avg("iou").alias("iou"), F.first("pixel_accuracy").alias("acc")
    )
    macro = per_sample.agg(F.avg("dice").alias("dice"), F.avg("iou").alias("iou"), F.avg("acc").alias("pixel_accuracy"))
    none = F.lit(None)
    return per_class.select("cls", "dice", "iou", none.cast("double").alias("pixel_accuracy")).unionByName(
        macro.select(none.cast("long").alias("cls"), "dice", "iou", "pixel_accuracy")
    )
