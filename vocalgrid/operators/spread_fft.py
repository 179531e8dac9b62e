"""Correlation and Hilbert transform of whole series by a Fourier transform that is spread over tasks.

A series of n samples is laid into a grid of rows and columns, powers of two near the square root of 2n. The
transform runs over columns, then over rows, where the two spectra are multiplied and turned back, then over
columns again. What moves between tasks are square tiles, so a shuffle sees one row per 4,096 values, and a task
holds 64 columns or 64 rows however long the series is. Every series takes this one path.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalgrid import scale

BITS = 6
TILE = 1 << BITS


def grid(n: int) -> tuple[int, int]:
    """Rows and columns with rows * columns >= 2n - 1."""
    bits = max(int(2 * n - 2).bit_length(), 1)
    columns = 1 << max(BITS, bits - bits // 2)
    return max((1 << bits) // columns, 1), columns


def hilbert_weights(n: int, lag: np.ndarray) -> np.ndarray:
    """Circular Hilbert kernel of length n at the given lags."""
    k = np.mod(lag, n)
    angle = np.pi * np.where(k == 0, 1, k) / n
    if n % 2 == 0:
        return np.where(k % 2 == 1, 2.0 / n / np.tan(angle), 0.0)
    return np.where(k == 0, 0.0, (np.cos(angle) - np.where(k % 2 == 0, 1.0, -1.0)) / np.sin(angle) / n)


def _signed(place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The lag of each place of the grid, and whether a series of n samples has that lag."""
    rows, columns = grid(n)
    lag = np.where(place < n, place, place - rows * columns)
    return lag, np.abs(lag) < n


def _turns(n: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    rows, columns = grid(n)
    return np.exp(-2j * np.pi * (first[:, None] * second) / (rows * columns))


def _keyed(pdf: pd.DataFrame, keys: list[str], count: int) -> pd.DataFrame:
    return pdf[keys].iloc[[0] * count].reset_index(drop=True)


def blocks(df: DataFrame, keys: Sequence[str], idx: str, value: str, n: str, side: int = 0) -> DataFrame:
    """A series (dense 0-based ``idx``) as arrays of 64 values with the number of samples ``n`` beside them."""
    placed = df.select(
        *keys, F.col(n).cast("long").alias("_n"), F.floor(F.col(idx) / TILE).cast("long").alias("_q"),
        F.struct(F.col(idx), F.col(value).cast("double").alias("_x")).alias("_r"),
    )
    held = placed.groupBy(*keys, "_n", "_q").agg(F.array_sort(F.collect_list("_r")).alias("_r"))
    return held.select(*keys, "_n", "_q", F.lit(side).alias("_side"), F.col("_r._x").alias("_x"))


def _convolved(
    parts: DataFrame,
    keys: Sequence[str],
    kernel: Callable[[int, np.ndarray], np.ndarray] | None,
    finish: Callable[[pd.DataFrame, int, np.ndarray, np.ndarray], pd.DataFrame],
    schema: str,
) -> DataFrame:
    """Blocks of side 0 convolved with ``kernel``, or correlated with side 1 where there is none.

    ``finish`` makes the result rows of one group of columns from its keys, n, places and values.
    """
    on = list(keys)
    typed = ", ".join(f"`{k}` {parts.schema[k].dataType.simpleString()}" for k in on)

    def over_columns(pdf: pd.DataFrame) -> pd.DataFrame:
        n, group = int(pdf["_n"].iloc[0]), int(pdf["_g"].iloc[0])
        rows, columns = grid(n)
        column = group * TILE + np.arange(TILE, dtype=np.int64)
        x = np.zeros((2, rows, TILE))
        for side, q, values in zip(pdf["_side"], pdf["_q"], pdf["_x"]):
            x[side, q // (columns // TILE), : len(values)] = values
        if kernel is not None:
            lag, real = _signed(np.arange(rows, dtype=np.int64)[:, None] * columns + column, n)
            x[1] = np.where(real, kernel(n, lag), 0.0)
        spectrum = np.fft.fft(x, axis=1) * _turns(n, np.arange(rows, dtype=np.int64), column)
        cuts = range(0, rows, TILE)
        return _keyed(pdf, on, len(cuts)).assign(
            _n=n, _g=group, _h=[c // TILE for c in cuts], _t=[spectrum[:, c : c + TILE].tobytes() for c in cuts]
        )

    def over_rows(pdf: pd.DataFrame) -> pd.DataFrame:
        n, part = int(pdf["_n"].iloc[0]), int(pdf["_h"].iloc[0])
        rows, columns = grid(n)
        own = part * TILE + np.arange(min(TILE, rows), dtype=np.int64)
        whole = np.zeros((2, len(own), columns), dtype=complex)
        for group, tile in zip(pdf["_g"], pdf["_t"]):
            whole[:, :, group * TILE : (group + 1) * TILE] = np.frombuffer(tile, dtype=complex).reshape(2, len(own), TILE)
        x, y = np.fft.fft(whole, axis=2)
        back = np.fft.ifft(x * (np.conj(y) if kernel is None else y), axis=1)
        back *= np.conj(_turns(n, own, np.arange(columns, dtype=np.int64)))
        cuts = range(0, columns, TILE)
        return _keyed(pdf, on, len(cuts)).assign(
            _n=n, _g=[c // TILE for c in cuts], _h=part, _t=[back[:, c : c + TILE].tobytes() for c in cuts]
        )

    def back_over_columns(pdf: pd.DataFrame) -> pd.DataFrame:
        n, group = int(pdf["_n"].iloc[0]), int(pdf["_g"].iloc[0])
        rows, columns = grid(n)
        held = np.zeros((rows, TILE), dtype=complex)
        for part, tile in zip(pdf["_h"], pdf["_t"]):
            held[part * TILE : (part + 1) * TILE] = np.frombuffer(tile, dtype=complex).reshape(-1, TILE)
        place = np.arange(rows, dtype=np.int64)[:, None] * columns + group * TILE + np.arange(TILE, dtype=np.int64)
        return finish(pdf[on], n, place, np.fft.ifft(held, axis=0).real)

    bits = F.greatest(F.length(F.bin(2 * F.col("_n") - 2)), F.lit(1))
    across = F.expr(f"shiftleft(1L, greatest({BITS}, _bits - _bits div 2) - {BITS})")
    grouped = parts.withColumn("_bits", bits.cast("int")).withColumn("_g", F.col("_q") % across).drop("_bits")
    tiles = f"{typed}, _n long, _g long, _h long, _t binary"
    first = grouped.groupBy(*on, "_n", "_g").applyInPandas(over_columns, tiles)
    second = first.groupBy(*on, "_n", "_h").applyInPandas(over_rows, tiles)
    return second.groupBy(*on, "_n", "_g").applyInPandas(back_over_columns, f"{typed}, {schema}")


def hilbert_blocks(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The Hilbert transform of series in blocks: keys, _q, _y (64 values; those beyond the end are zero)."""

    def finish(keyed: pd.DataFrame, n: int, place: np.ndarray, values: np.ndarray) -> pd.DataFrame:
        inside = place[:, 0] < n
        kept = np.where(place < n, values, 0.0)[inside]
        return _keyed(keyed, list(keyed.columns), len(kept)).assign(_q=place[inside, 0] // TILE, _y=list(kept))

    return _convolved(parts, keys, hilbert_weights, finish, "_q long, _y array<double>")


def correlations(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """sum over i of a[i + lag] * b[i] for every lag at which the series meet: keys, lag, total."""

    def finish(keyed: pd.DataFrame, n: int, place: np.ndarray, values: np.ndarray) -> pd.DataFrame:
        lag, real = _signed(place, n)
        return _keyed(keyed, list(keyed.columns), int(real.sum())).assign(lag=lag[real], total=values[real])

    return _convolved(a.unionByName(b), keys, None, finish, "lag long, total double")


def best_correlation(a: DataFrame, b: DataFrame, keys: Sequence[str], digits: int = 12) -> DataFrame:
    """Lag with the greatest total / n, of all lags from -floor(n/2) to n-1-floor(n/2): keys, lag, correlation.

    Correlations equal at ``digits`` decimals tie, and the smallest lag of a tie counts. Each task keeps its best
    lag, so the last shuffle holds one row per 64 columns.
    """

    def finish(keyed: pd.DataFrame, n: int, place: np.ndarray, values: np.ndarray) -> pd.DataFrame:
        lag, real = _signed(place, n)
        real &= (lag >= -(n // 2)) & (lag <= n - 1 - n // 2)
        if not real.any():
            return _keyed(keyed, list(keyed.columns), 0).assign(lag=np.zeros(0, np.int64), correlation=np.zeros(0))
        lags, share = lag[real], np.round(values[real] / n, digits)
        best = lags[share == share.max()].min() if not np.isnan(share).all() else lags.min()
        return _keyed(keyed, list(keyed.columns), 1).assign(lag=best, correlation=share[lags == best])

    found = _convolved(a.unionByName(b), keys, None, finish, "lag long, correlation double")
    top = F.max_by(F.struct("lag", "correlation"), F.struct(F.col("correlation"), -F.col("lag")))
    return found.groupBy(*keys).agg(top.alias("_best")).select(*keys, "_best.*")


def sized(df: DataFrame, keys: Sequence[str], idx: str, name: str = "_n") -> DataFrame:
    """Each row with the number of samples of its series."""
    return scale.with_group_size(df, keys, [idx], name)
