"""Operators on frame tables: keys, a dense frame position, and row-major pixel arrays."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocalgrid import scale
from vocalgrid.functions import columns as C
from vocalgrid.functions import kernels
from vocalgrid.functions.arrow import batch_kernel, guarded_kernel
from vocalgrid.operators import series

BLOCK = 64


def pixel_rows(df: DataFrame, keys: Sequence[str], pixels: str, width: int, value: str = "value") -> DataFrame:
    """One row per pixel with y and x."""
    wide = df.select(*keys, F.posexplode(pixels).alias("_i", value))
    return wide.select(
        *keys,
        F.floor(F.col("_i") / width).cast("long").alias("y"),
        (F.col("_i") % width).cast("long").alias("x"),
        value,
    )


def motion_energy(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    pixels: str,
    kind: str = "l1",
    width: int | None = None,
    roi: tuple[int, int, int, int] | None = None,
    out: str = "energy",
) -> DataFrame:
    """Change from the previous frame: ``l1`` sum of |diff| (first frame 0), ``rms`` (first dropped)."""
    frame = F.col(pixels) if roi is None else C.crop(F.col(pixels), width, *roi)
    narrow = df.select(*keys, idx, frame.alias("_p"))
    pairs = series.with_previous(narrow, keys, idx, {"_p": "_q"}, block=BLOCK)
    if kind == "rms":
        pairs = pairs.where(F.col("_q").isNotNull())
    elif kind != "l1":
        raise ValueError(f"unknown kind {kind}")

    def change(rows: np.ndarray) -> np.ndarray:
        now, before = np.split(rows, 2, axis=1)
        diff = now - before
        total = np.abs(diff).sum(axis=1) if kind == "l1" else np.sqrt((diff * diff).mean(axis=1))
        return total[:, None]

    # The first frame is set against itself.
    energy = batch_kernel(change)(F.concat("_p", F.coalesce("_q", "_p")))
    return pairs.select(*keys, idx, energy[0].alias(out))


def temporal_median(df: DataFrame, keys: Sequence[str], idx: str, pixels: str, window: int = 3, carry: Sequence[str] = ()) -> DataFrame:
    """Per-pixel median over ``window`` frames, ends repeated; shorter utterances stay unchanged. ``carry`` names columns that go along."""
    if window % 2 == 0 or window < 1:
        raise ValueError("the window must be odd")
    half, block = window // 2, max(BLOCK, window)
    # Frames meet their neighbours in one shuffle; only those beside a block's border are copied.
    copied = scale.halo_copies(df.select(*keys, idx, F.struct(pixels).alias("_f"), *carry), idx, block, half, half)
    whole = Window.partitionBy(*keys, "block")
    for k in range(window):
        copied = copied.withColumn(f"_f{k}", F.lag("_f", half - k).over(whole.orderBy(idx)))
    held = copied.withColumn("_m", F.count(F.lit(1)).over(whole)).where(scale.in_own_block(idx, block))
    every = F.array(*[F.col(f"_f{k}") for k in range(window)])
    # Places without a frame lie beyond an end; there the series is mirrored with its end frames repeated.
    behind = sum((F.col(f"_f{k}").isNotNull().cast("int") for k in range(half + 1, window)), F.lit(0))
    place = F.least(F.col(idx), F.lit(half)).cast("int")
    near = [
        F.coalesce(F.col(f"_f{k}"), F.get(every, (2 * half - 1 - k - 2 * place) if k < half else (2 * half + 1 - k + 2 * behind)))[pixels].alias(f"_n{k}")
        for k in range(window)
    ]
    # A series that ends within its first block and is shorter than the window is left as it is.
    short = (F.col("block") == 0) & (F.col("_m") < window)
    ready = held.select(*keys, idx, *carry, short.alias("_short"), F.col("_f")[pixels].alias(pixels), *near)

    def middle(_: Column, i: Column) -> Column:
        around = [F.get(f"_n{k}", i) for k in range(window)]
        if window == 3:
            a, b, c = around
            return F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))
        return F.array_sort(F.array(*around))[half]

    return ready.select(*keys, idx, F.when(F.col("_short"), F.col(pixels)).otherwise(F.transform(pixels, middle)).alias(pixels), *carry)


def spatial_gaussian(height: int, width: int, sigma: float) -> Callable[[Column], Column]:
    """Separable blur of size 2 * ceil(3 sigma) + 1, ends mirrored without repeating the edge."""
    return batch_kernel(blur_kernel(height, width, sigma))


def smoothing_kernel(height: int, width: int, sigma: float) -> Callable[[np.ndarray], np.ndarray]:
    """Kernel: Gaussian with radius int(4 sigma + 0.5) both ways, edges repeated; none for sigma 0."""
    if sigma <= 0:
        return lambda rows: rows
    weights = kernels.gaussian(int(4 * sigma + 0.5), sigma)
    left, right = (kernels.mirror_matrix(n, weights, repeat_edge=True) for n in (height, width))
    return lambda rows: kernels.smooth_frames(rows.reshape(-1, height, width), left, right).reshape(len(rows), -1)


def denoise(
    df: DataFrame, keys: Sequence[str], idx: str, pixels: str, height: int, width: int, sigma: float = 1.0, window: int = 3
) -> DataFrame:
    """Spatial blur of each frame, then the temporal median."""
    blur = spatial_gaussian(height, width, sigma)
    return temporal_median(df.withColumn(pixels, blur(F.col(pixels))), keys, idx, pixels, window)


def blur_kernel(height: int, width: int, sigma: float) -> Callable[[np.ndarray], np.ndarray]:
    """The spatial blur as a kernel of frame rows, or of rows that hold several channels one after the other."""
    weights = kernels.gaussian(math.ceil(3 * sigma), sigma)
    left, right = (kernels.mirror_matrix(n, weights, repeat_edge=False) for n in (height, width))
    return lambda rows: kernels.smooth_frames(rows.reshape(-1, height, width), left, right).reshape(len(rows), -1)


def denoise_guarded(
    df: DataFrame, keys: Sequence[str], idx: str, pixels: str, blur: Callable[[np.ndarray], np.ndarray], window: int = 3
) -> DataFrame:
    """``denoise`` with any kernel of frame rows; a frame on which it fails has no pixels and the reason in ``error``."""
    made = df.select(*keys, idx, guarded_kernel(blur)(F.col(pixels)).alias("_g"))
    held = made.select(*keys, idx, F.col("_g.value").alias(pixels), F.when(F.col("_g").isNull(), "no frame").otherwise(F.col("_g.error")).alias("error"))
    return temporal_median(held, keys, idx, pixels, window, carry=["error"])


def turn_pair(height: int, width: int) -> Callable[[Column], Column]:
    """(flip, degrees, image, mask) as one array to (image, mask), mirrored if flip is 1, then turned.

    Mask values are truncated to classes; with 0 degrees nothing is turned.
    """

    def run(rows: np.ndarray) -> np.ndarray:
        flip, degrees = rows[:, 0] == 1, rows[:, 1]
        pairs = rows[:, 2:].reshape(len(rows), 2, height, width).copy()
        pairs[flip] = pairs[flip][..., ::-1]
        moved = degrees != 0
        for part in (0, 1):
            pairs[moved, part] = kernels.rotate_frames(pairs[moved, part], degrees[moved])
        # Sums of shares of whole classes: what rounding took off an exact class is given back.
        pairs[moved, 1] = np.floor(pairs[moved, 1] + 1e-9)
        return pairs.reshape(len(rows), -1)

    return batch_kernel(run)


def augment(
    df: DataFrame, key: Sequence[str], image: str, mask: str, height: int, width: int, seed: int = 42, rotate: bool = True
) -> DataFrame:
    """Flip, rotation, brightness and contrast, each with probability one half.

    Draws come from a hash of seed, key and step, so a rerun gives the same result. The mask follows
    flip and rotation; its rotated values are truncated to classes.
    """
    parts = [F.col(k) for k in key]
    u = lambda step: C.draw(seed, *parts, F.lit(step))
    img, msk = F.col(image), F.col(mask)
    flip = u("flip") > 0.5
    if rotate:
        degrees = F.when(u("rotate") > 0.5, (u("angle") - 0.5) * 20).otherwise(0.0)
        size = height * width
        moves = F.array(flip.cast("double"), degrees)
        both = F.concat(moves, img, F.transform(msk, lambda v: v.cast("double")))
        out = df.withColumn("_both", turn_pair(height, width)(both))
        out = out.withColumn(image, F.slice("_both", 1, size))
        out = out.withColumn(mask, F.transform(F.slice("_both", size + 1, size), lambda v: v.cast("int"))).drop("_both")
    else:
        out = df.withColumn("_flip", flip)
        out = out.withColumn(image, F.when(F.col("_flip"), C.flip_frame(img, height, width)).otherwise(img))
        out = out.withColumn(mask, F.when(F.col("_flip"), C.flip_frame(msk, height, width)).otherwise(msk)).drop("_flip")
    bright = F.lit(0.8) + u("brightness_factor") * 0.4
    out = out.withColumn(image, F.when(u("brightness") > 0.5, C.adjust_brightness(img, bright)).otherwise(img))
    contrast = F.lit(0.8) + u("contrast_factor") * 0.4
    out = out.withColumn(image, F.when(u("contrast") > 0.5, C.adjust_contrast(img, contrast)).otherwise(img))
    return out


def class_distribution(df: DataFrame, keys: Sequence[str], mask: str, n_classes: int) -> DataFrame:
    """Share of each class per frame, the number of classes present and the dominant class.

    Counting stays inside the row, so no pixel is exploded and nothing is shuffled. The smallest
    class wins ties.
    """
    counts = df.select(*keys, *[C.count_value(F.col(mask), c).alias(f"_c{c}") for c in range(n_classes)], F.size(mask).alias("_n"))
    every = [F.col(f"_c{c}") for c in range(n_classes)]
    most = F.greatest(*every)
    dominant = F.coalesce(*[F.when(every[c] == most, F.lit(c)) for c in range(n_classes)])
    present = sum(((c > 0).cast("long") for c in every[1:]), (every[0] > 0).cast("long"))
    return counts.select(
        *keys,
        *[(every[c] / F.col("_n")).alias(f"share_{c}") for c in range(n_classes)],
        present.alias("n_present"),
        dominant.cast("long").alias("dominant"),
    )


def mean_class_distribution(df: DataFrame, utt: Sequence[str], keys: Sequence[str], mask: str, n_classes: int) -> DataFrame:
    shares = class_distribution(df, [*utt, *keys], mask, n_classes)
    return shares.groupBy(*utt).agg(
        *[F.avg(f"share_{c}").alias(f"share_{c}") for c in range(n_classes)], F.count(F.lit(1)).alias("n_frames")
    )


def frame_transform(
    df: DataFrame, image: str, mask: str, fn: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
) -> DataFrame:
    """User function on (images, masks) as batches of rows; it must keep the widths.

    Image and mask travel as one array, so both are changed by the same call.
    """

    def run(rows: np.ndarray) -> np.ndarray:
        size = rows.shape[1] // 2
        images, masks = fn(rows[:, :size], rows[:, size:].astype(np.int64))
        return np.concatenate([images, masks.astype(np.float64)], axis=1)

    both = F.concat(F.col(image), F.transform(F.col(mask), lambda v: v.cast("double")))
    out = df.withColumn("_both", batch_kernel(run)(both))
    size = F.floor(F.size("_both") / 2).cast("int")
    return (
        out.withColumn(image, F.slice("_both", F.lit(1), size))
        .withColumn(mask, F.transform(F.slice("_both", size + 1, size), lambda v: v.cast("int")))
        .drop("_both")
    )
