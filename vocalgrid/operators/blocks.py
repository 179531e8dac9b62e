"""Series as block tables: an array of neighbouring values per row instead of a row per value.

A block table has the series' keys, ``_q`` (number of the block), ``_n`` (values in the whole series) and one array a value
column; every block but a series' last holds ``span`` values. Smoothing, scaling, resampling, the Hilbert transform and correlation
keep that form, so a shuffle or a checkpoint sees one row per 4,096 values, and no task ever holds more than a few
blocks of a long series.

Transforms over a whole series have two forms with equal results: a series of at most ``WHOLE`` values is put into one row, and all
series of one length in a batch are transformed by one numpy call; a longer one goes over the spread grid (``spread_fft``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from vocalgrid import scale
from vocalgrid.fixed import SCALE_EPSILON
from vocalgrid.functions.arrow import batch_kernel
from vocalgrid.operators import spread_fft
from vocalgrid.session import pinned

SPAN = 4096
# Most values of a series that one row may hold: 8 MB.
WHOLE = 1 << 20


def span_for(radius: int) -> int:
    """A block length at which a window of that radius reaches into the next block only."""
    return SPAN * max(math.ceil(radius / SPAN), 1)


def from_rows(df: DataFrame, keys: Sequence[str], idx: str, values: Sequence[str], span: int = SPAN) -> DataFrame:
    """Block table of a series with one row per value; ``idx`` is the dense 0-based position."""
    cells = F.struct(F.col(idx).cast("long").alias("_i"), *[F.col(v).cast("double").alias(v) for v in values])
    placed = df.select(*keys, F.floor(F.col(idx) / span).cast("long").alias("_q"), cells.alias("_r"))
    held = placed.groupBy(*keys, "_q").agg(F.array_sort(F.collect_list("_r")).alias("_r"))
    # Sizes, the short and the long series each read the blocks: rows are gathered once.
    return sized(pinned(held.select(*keys, "_q", *[F.col(f"_r.{v}").alias(v) for v in values])), keys, values[0])


def sized(blocks: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Blocks with the number of values of their series."""
    sizes = blocks.groupBy(*keys).agg(F.sum(F.size(value)).cast("long").alias("_n"))
    return scale.attach(blocks, sizes, keys, ["_q"])


def reblocked(pieces: DataFrame, keys: Sequence[str], start: str, values: Sequence[str], span: int = SPAN) -> DataFrame:
    """Pieces of any length, each with the position of its first value, as blocks without ``_n``."""
    size, first = F.size(values[0]).cast("long"), F.col(start).cast("long")
    last = F.floor((first + size - 1) / span)

    def cut(q: Column) -> Column:
        begin = F.greatest(first, q * span)
        count = F.least(first + size, (q + 1) * span) - begin
        parts = [F.slice(v, (begin - first + 1).cast("int"), count.cast("int")).alias(v) for v in values]
        return F.struct(q.alias("_q"), F.struct(begin.alias("_s"), *parts).alias("_r"))

    cuts = pieces.where(size > 0).select(*keys, F.explode(F.transform(F.sequence(F.floor(first / span), last), cut)).alias("_c"))
    held = cuts.groupBy(*keys, F.col("_c._q").alias("_q")).agg(F.array_sort(F.collect_list("_c._r")).alias("_r"))
    return held.select(*keys, "_q", *[F.flatten(f"_r.{v}").alias(v) for v in values])


def to_rows(blocks: DataFrame, keys: Sequence[str], idx: str, value: str, out: str, span: int = SPAN) -> DataFrame:
    """One row per value again."""
    rows = blocks.select(*keys, "_q", F.posexplode(value).alias("_p", out))
    return rows.select(*keys, (F.col("_q") * span + F.col("_p")).cast("long").alias(idx), out)


def whole(blocks: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per series: for series whose length is known to be bounded."""
    held = blocks.groupBy(*keys, "_n").agg(F.array_sort(F.collect_list(F.struct("_q", *values))).alias("_b"))
    return held.select(*keys, "_n", *[F.flatten(f"_b.{v}").alias(v) for v in values])


def split(rows: DataFrame, keys: Sequence[str], value: str, span: int = SPAN) -> DataFrame:
    """Whole series cut into blocks."""
    cuts = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(value) - 1) / span).cast("int")),
        lambda q: F.struct(q.cast("long").alias("_q"), F.slice(value, q * span + 1, F.lit(span)).alias("_x")),
    )
    held = rows.where(F.size(value) > 0).select(*keys, "_n", F.explode(cuts).alias("_c"))
    return held.select(*keys, F.col("_c._q").alias("_q"), "_n", F.col("_c._x").alias(value))


def tiles(blocks: DataFrame, keys: Sequence[str], value: str, side: int = 0, span: int = SPAN, n: str = "_n") -> DataFrame:
    """The blocks as the spread transform takes them: 64 values a row."""
    per = span // spread_fft.TILE
    cuts = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(value) - 1) / spread_fft.TILE).cast("int")),
        lambda t: F.struct((F.col("_q") * per + t).alias("_t"), F.slice(value, t * spread_fft.TILE + 1, F.lit(spread_fft.TILE)).alias("_x")),
    )
    held = blocks.select(*keys, F.col(n).alias("_n"), F.explode(cuts).alias("_c"))
    return held.select(*keys, "_n", F.col("_c._t").alias("_q"), F.lit(side).alias("_side"), F.col("_c._x").alias("_x"))


# Local work ---------------------------------------------------------------------------------------


def _smoother(weights: np.ndarray) -> Callable[..., Column]:
    radius = len(weights) // 2

    @arrow_udf("array<double>")
    def run(head: pa.Array, own: pa.Array, tail: pa.Array) -> pa.Array:
        made = []
        for k in range(len(own)):
            parts = [np.zeros(0) if side[k].as_py() is None else np.asarray(side[k].values.to_numpy(zero_copy_only=False), dtype=float) for side in (head, own, tail)]
            # Only the two ends of a series lack neighbours: there it is mirrored with its end values repeated.
            missing = radius - len(parts[0]), radius - len(parts[2])
            x = np.pad(np.concatenate(parts), missing, mode="symmetric")
            if radius <= 64:
                made.append(np.convolve(x, weights, "valid"))
            else:
                size = 1 << (len(x) + 2 * radius).bit_length()
                made.append(np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(weights, size), size)[2 * radius : len(x)])
        return pa.array(made, pa.list_(pa.float64()))

    return run


def smoothed(blocks: DataFrame, keys: Sequence[str], value: str, weights: Sequence[float]) -> DataFrame:
    """Weighted sums over neighbours at offsets -r..r (symmetric weights), ends reflected; r must not exceed the block length."""
    radius = len(weights) // 2
    if radius == 0:
        return blocks
    # Blocks and the ends they lend each other meet in one shuffle. ``_n`` rides in the key.
    met = scale.block_neighbours(blocks.select(*keys, "_n", "_q", value), [*keys, "_n"], "_q", value, radius, radius)
    run = _smoother(np.array(weights, dtype=float))
    return met.where(F.col(value).isNotNull()).select(*keys, "_q", "_n", run("_head", value, "_tail").alias(value))


def _ends(blocks: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return blocks.groupBy(*keys).agg(F.min(F.array_min(value)).alias("_lo"), F.max(F.array_max(value)).alias("_hi"))


def minmax(blocks: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(v - min) / (max - min + 1e-8) over each series. The blocks are read twice."""
    held = scale.attach(blocks, _ends(blocks, keys, value), keys, ["_q"])
    span = F.col("_hi") - F.col("_lo") + F.lit(SCALE_EPSILON)
    return held.withColumn(value, F.transform(value, lambda v: (v - F.col("_lo")) / span)).drop("_lo", "_hi")


def zscore(blocks: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(v - mean) / (population std + 1e-8) over each series of values from 0 to 1. The blocks are read twice."""
    sums = batch_kernel(lambda rows: np.stack([rows.sum(axis=1), (rows * rows).sum(axis=1)], axis=1))
    parts = blocks.select(*keys, "_n", sums(F.col(value)).alias("_s"))
    total = parts.groupBy(*keys).agg(F.sum(F.col("_s")[0]).alias("_a"), F.sum(F.col("_s")[1]).alias("_b"))
    held = scale.attach(blocks, total, keys, ["_q"])
    mean = F.col("_a") / F.col("_n")
    spread = F.sqrt(F.greatest(F.col("_b") / F.col("_n") - mean * mean, F.lit(0.0))) + F.lit(SCALE_EPSILON)
    return held.withColumn(value, F.transform(value, lambda v: (v - mean) / spread)).drop("_a", "_b")


def resampled(blocks: DataFrame, keys: Sequence[str], value: str, source_rate: float, target_rate: float, targets: DataFrame, span: int = SPAN, out_span: int = SPAN) -> DataFrame:
    """Linear interpolation of values at i / source_rate to the times j / target_rate, 0 behind the last value.

    ``targets`` holds keys and the number of target values ``n_targets``. Series without a source value give no rows.
    """

    @arrow_udf("struct<start:bigint,x:array<double>>")
    def run(own: pa.Array, tail: pa.Array, q: pa.Array, most: pa.Array) -> pa.Array:
        starts, made = [], []
        for k in range(len(own)):
            x = np.asarray(own[k].values.to_numpy(zero_copy_only=False), dtype=float)
            after = tail[k].as_py() or []
            first = q[k].as_py() * span
            times = np.arange(first, first + len(x) + len(after)) / source_rate
            values = np.append(x, after)
            j = np.arange(max(math.floor(times[0] * target_rate) - 1, 0), min(math.ceil(times[-1] * target_rate) + 2, most[k].as_py()))
            at = j / target_rate
            # A block answers from its first value to the next block's first, the last one to its last value.
            inside = (at >= times[0]) & ((at < times[-1]) if after else (at <= times[-1]))
            starts.append(int(j[inside][0]) if inside.any() else 0)
            made.append(np.interp(at[inside], times, values))
        return pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(made, pa.list_(pa.float64()))], names=["start", "x"])

    met = scale.block_neighbours(blocks.select(*keys, "_q", value), keys, "_q", value, 0, 1).where(F.col(value).isNotNull())
    met = scale.attach(met, targets.select(*keys, "n_targets"), keys, ["_q"])
    pieces = met.select(*keys, run(value, "_tail", "_q", "n_targets").alias("_p"))
    held = reblocked(pieces.select(*keys, F.col("_p.start").alias("_start"), F.col("_p.x").alias(value)), keys, "_start", [value], out_span)
    known = blocks.select(*keys).distinct()
    wanted = targets.select(*keys, F.col("n_targets").cast("long").alias("_n")).join(known, list(keys), "left_semi")
    return _filled(held, wanted, keys, value, out_span)


def _filled(held: DataFrame, sizes: DataFrame, keys: Sequence[str], value: str, span: int) -> DataFrame:
    """Blocks whose ends are missing, or all of them, filled with zeros to the series' length ``_n`` in ``sizes``."""
    every = scale.explode_range(sizes.select(*keys, "_n"), F.lit(0), F.ceil(F.col("_n") / span), "_q")
    filled = every.join(held.select(*keys, "_q", value), [*keys, "_q"], "left")
    length = F.least(F.lit(span), F.col("_n") - F.col("_q") * span).cast("int")
    have = F.coalesce(value, F.array().cast("array<double>"))
    return filled.select(*keys, "_q", "_n", F.concat(have, F.array_repeat(F.lit(0.0), length - F.size(have))).alias(value))


def shifted(blocks: DataFrame, keys: Sequence[str], value: str, plan: DataFrame, span: int = SPAN) -> DataFrame:
    """out[n] = in[n + offset] for n < out_len, zero where there is no such value; ``plan`` holds keys, offset and out_len."""
    known = plan.select(*keys, F.col("offset").cast("long").alias("_o"), F.col("out_len").cast("long").alias("_len"))
    held = scale.attach(blocks.select(*keys, "_q", value), known, keys, ["_q"])
    start = F.col("_q") * span - F.col("_o")
    begin, end = F.greatest(start, F.lit(0)), F.least(start + F.size(value), F.col("_len"))
    moved = held.where(end > begin).select(*keys, begin.alias("_s"), F.slice(value, (begin - start + 1).cast("int"), (end - begin).cast("int")).alias(value))
    # What lies ahead of the series is filled here, what lies behind it by ``_filled``.
    gap = F.least(F.greatest(-F.col("_o"), F.lit(0)), F.col("_len"))
    ahead = scale.explode_range(known.withColumn("_gap", gap), F.lit(0), F.ceil(F.col("_gap") / span), "_q")
    size = F.least(F.lit(span), F.col("_gap") - F.col("_q") * span).cast("int")
    zeros = ahead.select(*keys, (F.col("_q") * span).alias("_s"), F.array_repeat(F.lit(0.0), size).alias(value))
    pieces = moved.unionByName(zeros)
    return _filled(reblocked(pieces, keys, "_s", [value], span), known.select(*keys, F.col("_len").alias("_n")), keys, value, span)


# Work over whole series -------------------------------------------------------------------------


def analytic_magnitudes(rows: np.ndarray) -> np.ndarray:
    """Magnitude of the analytic signal of each row."""
    n = rows.shape[1]
    turn = np.zeros(n)
    turn[0] = 1
    turn[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        turn[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(rows, axis=1) * turn, axis=1))


def magnitude(blocks: DataFrame, keys: Sequence[str], value: str, span: int = SPAN, most: int = WHOLE) -> DataFrame:
    """Block table of the analytic signal's magnitude."""
    on = list(keys)
    short = whole(blocks.where(F.col("_n") <= most), on, [value])
    near = split(short.withColumn(value, batch_kernel(analytic_magnitudes)(F.col(value))), on, value, span)
    parts = tiles(blocks.where(F.col("_n") > most), on, value, span=span)
    turned = spread_fft.hilbert_blocks(parts, on)
    size = F.zip_with("_x", F.slice("_y", F.lit(1), F.size("_x")), lambda x, y: F.sqrt(x * x + y * y))
    per = span // spread_fft.TILE
    met = parts.join(turned, [*on, "_q"]).select(*on, "_n", F.floor(F.col("_q") / per).alias("_b"), F.struct("_q", size.alias("_m")).alias("_r"))
    far = met.groupBy(*on, "_n", "_b").agg(F.array_sort(F.collect_list("_r")).alias("_r"))
    return near.unionByName(far.select(*on, F.col("_b").alias("_q"), "_n", F.flatten("_r._m").alias(value)))


def _correlated(rows: np.ndarray) -> tuple[np.ndarray, int]:
    """sum over i of a[i + lag] * b[i] for rows that hold a and b one after the other; lag modulo the second result."""
    a, b = np.split(rows, 2, axis=1)
    size = 1 << max(2 * a.shape[1] - 2, 0).bit_length()
    return np.fft.irfft(np.fft.rfft(a, size, axis=1) * np.conj(np.fft.rfft(b, size, axis=1)), size, axis=1) if size > 1 else a * b, size


def _all_lags(rows: np.ndarray) -> np.ndarray:
    totals, size = _correlated(rows)
    n = rows.shape[1] // 2
    return totals[:, np.arange(1 - n, n) % size]


def _best_lag(digits: int) -> Callable[[np.ndarray], np.ndarray]:
    def run(rows: np.ndarray) -> np.ndarray:
        totals, size = _correlated(rows)
        n = rows.shape[1] // 2
        lags = np.arange(-(n // 2), n - n // 2)
        share = np.round(totals[:, lags % size] / n, digits)
        at = np.where(np.isnan(share).all(axis=1), 0, np.nanargmax(np.where(np.isnan(share), -np.inf, share), axis=1))
        return np.stack([lags[at].astype(float), share[np.arange(len(rows)), at]], axis=1)

    return run


def lag_products(blocks: DataFrame, keys: Sequence[str], a: str, b: str, span: int = SPAN, most: int = WHOLE) -> DataFrame:
    """keys, lag, total: sum over i of a[i + lag] * b[i] at every lag at which the series meet."""
    on = list(keys)
    short = whole(blocks.where(F.col("_n") <= most), on, [a, b])
    products = short.select(*on, "_n", F.posexplode(batch_kernel(_all_lags)(F.concat(a, b))).alias("_p", "total"))
    near = products.select(*on, (F.col("_p") - F.col("_n") + 1).cast("long").alias("lag"), "total")
    long = blocks.where(F.col("_n") > most)
    far = spread_fft.correlations(tiles(long, on, a, 0, span), tiles(long, on, b, 1, span), on)
    return near.unionByName(far)


def best_correlation(a: DataFrame, b: DataFrame, keys: Sequence[str], value_a: str, value_b: str, lengths: DataFrame, span: int = SPAN, most: int = WHOLE, digits: int = 12) -> DataFrame:
    """keys, lag, correlation: the lag with the greatest sum / N of two series padded with zeros to N.

    ``lengths`` holds keys and N as ``length``. Lags from -floor(N/2) to N-1-floor(N/2) are tried; correlations equal at
    ``digits`` decimals tie, and the smallest lag of a tie counts.
    """
    on = list(keys)
    known = lengths.select(*on, F.col("length").cast("long").alias("_len"))
    sides = [
        scale.attach(df.select(*on, "_q", F.col(v).alias("_x")), known, on, ["_q"]).withColumn("_side", F.lit(k)) for k, (df, v) in enumerate(((a, value_a), (b, value_b)))
    ]
    both = sides[0].unionByName(sides[1])
    held = both.where(F.col("_len") <= most).groupBy(*on, "_len").agg(F.array_sort(F.collect_list(F.struct("_side", "_q", "_x"))).alias("_b"))

    def padded(side: int) -> Column:
        own = F.flatten(F.transform(F.filter("_b", lambda r: r["_side"] == side), lambda r: r["_x"]))
        return F.concat(own, F.array_repeat(F.lit(0.0), F.col("_len").cast("int") - F.size(own)))

    found = held.select(*on, batch_kernel(_best_lag(digits))(F.concat(padded(0), padded(1))).alias("_f"))
    near = found.select(*on, F.col("_f")[0].cast("long").alias("lag"), F.col("_f")[1].alias("correlation"))
    long = [side.where(F.col("_len") > most) for side in sides]
    far = spread_fft.best_correlation(*[tiles(side, on, "_x", k, span, "_len") for k, side in enumerate(long)], on, digits)
    return near.unionByName(far)
