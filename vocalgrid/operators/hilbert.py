"""Magnitude of the analytic signal of whole series, in blocks (``blocks.magnitude``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from vocalgrid.operators import blocks


def magnitude(df: DataFrame, keys: Sequence[str], idx: str, value: str, out: str = "magnitude") -> DataFrame:
    """Returns keys, idx, out. ``idx`` must be the dense 0-based position."""
    held = blocks.from_rows(df, keys, idx, [value])
    return blocks.to_rows(blocks.magnitude(held, keys, value), keys, idx, value, out)
