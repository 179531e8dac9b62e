"""Thresholds, regions and rule labels for frames. Frames are independent: no operator shuffles pixels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocalgrid import fixed
from vocalgrid.functions import columns as C
from vocalgrid.functions import kernels
from vocalgrid.functions.arrow import batch_kernel
from vocalgrid.operators.frames import smoothing_kernel


def otsu_threshold(df: DataFrame, keys: Sequence[str], pixels: str, bins: int = 256) -> DataFrame:
    """Threshold with the greatest between-class variance per frame; 0.5 for a uniform frame, null for a null one."""
    found = batch_kernel(lambda rows: kernels.otsu_thresholds(rows, bins)[:, None])(F.col(pixels))
    return df.select(*keys, F.get(found, 0).alias("threshold"))


def _smoothed(height: int, width: int, sigma: float) -> Callable[[np.ndarray], np.ndarray]:
    """Kernel: divide by the maximum where it exceeds 1, then smooth."""
    blur = smoothing_kernel(height, width, sigma)

    def run(rows: np.ndarray) -> np.ndarray:
        return blur(rows / np.maximum(rows.max(axis=1, keepdims=True), 1.0))

    return run


def tissue_mask(
    df: DataFrame,
    pixels: str,
    height: int,
    width: int,
    sigma: float = 1.0,
    threshold: float | None = None,
    min_area: int = 0,
    bins: int = 256,
    out: str = "tissue",
) -> DataFrame:
    """Add the threshold and the mask (0/1) of pixels above it after smoothing; small regions dropped."""
    smooth = _smoothed(height, width, sigma)

    def run(rows: np.ndarray) -> np.ndarray:
        values = smooth(rows)
        limit = kernels.otsu_thresholds(values, bins) if threshold is None else np.full(len(rows), float(threshold))
        mask = values > limit[:, None]
        if min_area > 0:
            mask = kernels.drop_small(mask.reshape(-1, height, width), min_area).reshape(len(rows), -1)
        return np.concatenate([limit[:, None], mask], axis=1)

    # One kernel call gives both: the threshold leads the mask.
    held = df.withColumn("_t", batch_kernel(run)(F.col(pixels)))
    mask = F.transform(F.slice("_t", 2, height * width), lambda v: v.cast("int"))
    return held.withColumn("threshold", F.col("_t")[0]).withColumn(out, mask).drop("_t")


def multi_otsu(
    df: DataFrame, pixels: str, height: int, width: int, classes: int = 3, bins: int = 256, sigma: float = 1.0
) -> DataFrame:
    """Add the thresholds of ``classes`` intensity classes and the class of every pixel."""
    smooth = _smoothed(height, width, sigma)

    def run(rows: np.ndarray) -> np.ndarray:
        values = smooth(rows)
        limits = kernels.multi_otsu_thresholds(values, classes, bins)
        return np.concatenate([limits, (values[:, :, None] >= limits[:, None, :]).sum(axis=2)], axis=1)

    held = df.withColumn("_t", batch_kernel(run)(F.col(pixels)))
    classed = F.transform(F.slice("_t", classes, height * width), lambda v: v.cast("int"))
    return held.withColumn("thresholds", F.slice("_t", 1, classes - 1)).withColumn("classes", classed).drop("_t")


def _on_masks(fn, height: int, width: int):
    """Lift a kernel on boolean (batch, height, width) masks to a 0/1 array column function."""
    return batch_kernel(
        lambda rows: fn(rows.reshape(-1, height, width) != 0).reshape(len(rows), -1).astype(np.int32), "int"
    )


def region_label(height: int, width: int, connectivity: int = 8):
    """Region of each pixel, named by 1 + the index of its first pixel; background 0."""
    return _on_masks(lambda m: kernels.label_regions(m, connectivity), height, width)


def drop_small(height: int, width: int, min_area: int, connectivity: int = 4):
    return _on_masks(lambda m: kernels.drop_small(m, min_area, connectivity), height, width)


def largest_region(height: int, width: int, connectivity: int = 8):
    return _on_masks(lambda m: kernels.largest_region(m, connectivity), height, width)


def vocal_tract_mask(height: int, width: int, disk: int = 3):
    """From a tissue mask: fill holes, close, keep the largest region; all true if none is found."""

    def run(masks: np.ndarray) -> np.ndarray:
        closed = kernels.close_disk(kernels.fill_holes(masks), disk)
        found = closed.any(axis=(1, 2), keepdims=True)
        return kernels.largest_region(closed) | ~found

    return _on_masks(run, height, width)


def label_rules(tissue: Column, tract: Column, height: int, width: int) -> Column:
    """Classes by place: tissue in the central rectangle is tongue below 40 % of the height and jaw
    above it; tissue at the left and right fifth is lips, which overrides; everything else is 0."""
    top, left = int(height * 0.2), int(width * 0.2)
    low_from, right_from = int(height * 0.4), int(width * 0.8)

    def rule(inside: Column, i: Column) -> Column:
        y, x = F.floor(i / width), i % width
        central = (y >= top) & (y < height - top) & (x >= left) & (x < width - left)
        return (
            F.when(~inside, fixed.BACKGROUND)
            .when((x < left) | (x >= right_from), fixed.LIPS)
            .when(central & (y >= low_from), fixed.TONGUE)
            .when(central, fixed.JAW)
            .otherwise(fixed.BACKGROUND)
        )

    return F.transform(F.zip_with(tissue, tract, lambda t, v: (t != 0) & (v != 0)), rule)


def pseudo_labels(
    df: DataFrame,
    pixels: str,
    height: int,
    width: int,
    method: str = "combined",
    sigma: float = 1.0,
    min_area: int = 0,
    bins: int = 256,
    disk: int = 3,
) -> DataFrame:
    """Label frames: ``otsu`` for three intensity classes, or ``combined`` for the place rules."""
    held = tissue_mask(df, pixels, height, width, sigma, None, min_area, bins)
    held = held.withColumn("tract", vocal_tract_mask(height, width, disk)(F.col("tissue")))
    if method == "combined":
        return held.withColumn("label", label_rules(F.col("tissue"), F.col("tract"), height, width))
    if method == "otsu":
        classed = multi_otsu(held, pixels, height, width, 3, bins, sigma)
        return classed.withColumnRenamed("classes", "label").drop("thresholds")
    raise ValueError(f"unknown method {method}")


def label_counts(df: DataFrame, keys: Sequence[str], label: str, n_classes: int) -> DataFrame:
    """Pixels of each class that a label frame holds, one row per class present; counted inside the row."""
    counts = F.array(*[C.count_value(F.col(label), c) for c in range(n_classes)])
    rows = df.select(*keys, F.posexplode(counts).alias("class", "pixels"))
    return rows.where("pixels > 0").select(*keys, F.col("class").cast("long").alias("class"), F.col("pixels").cast("long").alias("pixels"))
