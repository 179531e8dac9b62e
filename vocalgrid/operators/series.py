"""Operators on sampled series: one row per (utterance keys, position, value)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from vocalgrid import scale
from vocalgrid.fixed import POWER_FLOOR, SCALE_EPSILON, TOP_DB
from vocalgrid.operators import blocks

BLOCK = 1024


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    """Normalised weights for offsets -r..r with r = int(truncate * sigma + 0.5)."""
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    total = sum(raw)
    return [w / total for w in raw]


def weighted_neighbours(
    df: DataFrame, keys: Sequence[str], idx: str, value: str, weights: Sequence[float], out: str, block: int | None = None
) -> DataFrame:
    """Sum of weights times neighbours at offsets -r..r, ends reflected; returns keys, idx, out."""
    span = max(block or 0, len(weights) // 2) if block else blocks.span_for(len(weights) // 2)
    held = blocks.from_rows(df, keys, idx, [value], span)
    return blocks.to_rows(blocks.smoothed(held, keys, value, weights), keys, idx, value, out, span)


def gaussian_smooth(
    df: DataFrame, keys: Sequence[str], idx: str, value: str, sigma_ms: float, rate: float, out: str = "smoothed"
) -> DataFrame:
    """Gaussian smoothing with sigma in milliseconds; nothing is done for sigma <= 0."""
    weights = smoothing_weights(sigma_ms, rate)
    if len(weights) == 1:
        return df.select(*keys, idx, F.col(value).cast("double").alias(out))
    return weighted_neighbours(df, keys, idx, value, weights, out)


def smoothing_weights(sigma_ms: float, rate: float) -> list[float]:
    """Weights of a Gaussian of ``sigma_ms`` milliseconds; one weight where it does nothing."""
    sigma = sigma_ms / 1000.0 * rate
    return [1.0] if sigma_ms <= 0 or int(4.0 * sigma + 0.5) == 0 else gaussian_weights(sigma)


def group_minmax(df: DataFrame, keys: Sequence[str], idx: str, value: str, out: str = "scaled") -> DataFrame:
    """(v - min) / (max - min + 1e-8) per group."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    span = F.col("_hi") - F.col("_lo") + F.lit(SCALE_EPSILON)
    return (
        scale.attach(df, ends, keys, spread_on=[idx])
        .withColumn(out, (F.col(value) - F.col("_lo")) / span)
        .drop("_lo", "_hi")
    )


def with_next(
    df: DataFrame, keys: Sequence[str], idx: str, columns: dict[str, str], block: int = BLOCK
) -> DataFrame:
    """Add each column's value at the next position, windows bounded by ``block`` rows."""
    copied = scale.halo_copies(df, idx, block, 0, 1)
    window = Window.partitionBy(*keys, "block").orderBy(idx)
    for source, name in columns.items():
        copied = copied.withColumn(name, F.lead(source).over(window))
    return copied.where(scale.in_own_block(idx, block)).drop("block")


def with_previous(
    df: DataFrame, keys: Sequence[str], idx: str, columns: dict[str, str], block: int = BLOCK
) -> DataFrame:
    """Add each column's value at the previous position, windows bounded by ``block`` rows."""
    copied = scale.halo_copies(df, idx, block, 1, 0)
    window = Window.partitionBy(*keys, "block").orderBy(idx)
    for source, name in columns.items():
        copied = copied.withColumn(name, F.lag(source).over(window))
    return copied.where(scale.in_own_block(idx, block)).drop("block")


def interpolate(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    time: str,
    values: Sequence[str],
    targets: DataFrame,
    rate: float,
    mode: str = "clamp",
    n_targets: str = "n_targets",
    out_idx: str = "target_idx",
) -> DataFrame:
    """Linear interpolation of ``values`` at times j / rate, j = 0 .. n_targets-1.

    ``idx`` is the dense position of the source samples and ``time`` their increasing time.
    ``targets`` holds keys and the target count; groups without a source sample give no rows.
    Every source interval emits the target points it covers, so no as-of join is needed. Outside
    the source span, ``clamp`` holds the end values and ``zero`` gives 0.
    """
    if mode not in ("clamp", "zero"):
        raise ValueError(f"unknown mode {mode}")
    source = df.select(*keys, idx, F.col(time).cast("double").alias("_t"), *values)
    nexts = {"_t": "_t1"} | {v: f"_next_{v}" for v in values}
    segments = with_next(source, keys, idx, nexts)
    segments = scale.attach(segments, targets.select(*keys, F.col(n_targets).alias("_m")), keys, [idx])
    r = F.lit(float(rate))
    is_last = F.col("_t1").isNull()
    # Point j lies in [t, t1); the bounds are widened by one and the exact test follows.
    low = F.when(F.col(idx) == 0, F.lit(0)).otherwise(F.greatest(F.floor(F.col("_t") * r) - 1, F.lit(0)))
    high = F.when(is_last, F.col("_m")).otherwise(F.least(F.ceil(F.col("_t1") * r) + 2, F.col("_m")))
    points = scale.explode_range(segments, low, high, out_idx)
    at = F.col(out_idx).cast("double") / r
    inside = ((at >= F.col("_t")) | (F.col(idx) == 0)) & (is_last | (at < F.col("_t1")))
    points = points.where(inside)
    outside = (at < F.col("_t")) | (is_last & (at > F.col("_t")))
    share = (at - F.col("_t")) / (F.col("_t1") - F.col("_t"))

    def blend(v: str) -> Column:
        here, after = F.col(v), F.col(f"_next_{v}")
        if isinstance(df.schema[v].dataType, ArrayType):
            mixed = F.zip_with(here, after, lambda a, b: a + (b - a) * share)
            still = here if mode == "clamp" else F.transform(here, lambda a: a * 0)
        else:
            mixed = here + (after - here) * share
            still = here if mode == "clamp" else F.lit(0.0)
        return F.when(outside, still).when(is_last, here).otherwise(mixed).alias(v)

    return points.select(*keys, F.col(out_idx).cast("long").alias(out_idx), *[blend(v) for v in values])


def lag_products(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    a: str,
    b: str,
    max_lag: int | None = None,
) -> DataFrame:
    """sum over n of a[n+lag] * b[n] for every lag at which the series meet; zero beyond the ends.

    All lags of a series come from one transform. A caller who wants near lags only may name ``max_lag``.
    Returns keys, lag, total.
    """
    rows = blocks.lag_products(blocks.from_rows(df, keys, idx, [a, b]), keys, a, b)
    return rows if max_lag is None else rows.where(F.abs("lag") <= max_lag)


def best_lag(products: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lag with the greatest product, the smallest lag on ties."""
    best = products.groupBy(*keys).agg(
        F.max_by(F.struct("lag", "total"), F.struct(F.col("total"), -F.col("lag"))).alias("_best")
    )
    return best.select(*keys, F.col("_best.lag").alias("lag"), F.col("_best.total").alias("total"))


def shift_series(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    value: str,
    plan: DataFrame,
    offset: str = "offset",
    out_len: str = "out_len",
    compat: bool = False,
) -> DataFrame:
    """Shift by ``offset`` samples and cut or zero-pad to ``out_len``; plan has one row per group.

    Default: out[n] = in[n + offset], which lines the audio up with the images. ``compat`` gives the
    other direction, a positive offset padding the front.
    """
    move = F.col("_o") if compat else -F.col("_o")
    per_group = plan.select(*keys, F.col(offset).alias("_o"), F.col(out_len).alias("_len"))
    moved = (
        scale.attach(df.select(*keys, idx, F.col(value).cast("double").alias(value)), per_group, keys, [idx])
        .withColumn(idx, F.col(idx) + move)
        .where((F.col(idx) >= 0) & (F.col(idx) < F.col("_len")))
        .select(*keys, idx, value)
    )
    sizes = scale.group_size(df, keys).join(per_group, list(keys)).withColumn("_move", move)
    front = F.least(F.greatest(F.col("_move"), F.lit(0)), F.col("_len"))
    tail = F.greatest(F.least(F.col("n") + F.col("_move"), F.col("_len")), F.lit(0))
    gaps = sizes.withColumn("_gap", F.explode(F.array(
        F.struct(F.lit(0).cast("long").alias("s"), front.cast("long").alias("e")),
        F.struct(F.greatest(tail, front).cast("long").alias("s"), F.col("_len").cast("long").alias("e")),
    )))
    zeros = scale.explode_range(gaps, F.col("_gap.s"), F.col("_gap.e"), idx)
    return moved.unionByName(zeros.select(*keys, idx, F.lit(0.0).alias(value)))


def power_to_db(power: Column, reference: Column) -> Column:
    """10 log10(power / reference), both floored at 1e-10."""
    floor = F.lit(POWER_FLOOR)
    return 10 * F.log10(F.greatest(power, floor)) - 10 * F.log10(F.greatest(reference, floor))


def group_db(df: DataFrame, keys: Sequence[str], idx: str, power: str, out: str = "db") -> DataFrame:
    """Decibels relative to the group's greatest power, clipped to the top 80 dB."""
    peak = df.groupBy(*keys).agg(F.max(power).alias("_peak"))
    level = power_to_db(F.col(power), F.col("_peak"))
    return scale.attach(df, peak, keys, [idx]).withColumn(out, F.greatest(level, F.lit(-TOP_DB))).drop("_peak")


def downmix(df: DataFrame, keys: Sequence[str], idx: str, value: str, out: str = "mono") -> DataFrame:
    """Mean over channels of each sample."""
    return df.groupBy(*keys, idx).agg(F.avg(value).alias(out))


def linspace_positions(per_group: DataFrame, size: str, k: int, out: str = "frame_idx") -> DataFrame:
    """k evenly spaced positions from 0 to size-1, truncated; positions repeat when k > size."""
    step = F.col("sample") * (F.col(size) - 1)
    place = F.when(F.lit(k) > 1, F.floor(step / F.lit(max(k - 1, 1)))).otherwise(F.lit(0))
    return per_group.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn(
        out, place.cast("long")
    )
