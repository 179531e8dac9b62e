"""Arrow batch kernels: numpy on whole batches of equally long frames, one call per batch.

A frame column is an ARRAY of numbers or, more compactly, a BINARY with one byte per pixel. Spark
hands arrays to Python workers element by element but binaries by block copy, so stored masks are
best kept packed (``pack``); every kernel takes both forms.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

# Values worked on at a time: a slice of this size and its temporaries stay in the CPU caches.
SLICE = 1 << 19
_DTYPES = {"double": np.float64, "int": np.int32, "boolean": np.bool_, "bytes": np.uint8, "rows": np.float64}


def _rows(values: pa.Array) -> np.ndarray:
    """Arrow list or binary array of equally long values without nulls to (rows, width)."""
    if pa.types.is_binary(values.type):
        offsets = np.frombuffer(values.buffers()[1], dtype=np.int32)[values.offset : values.offset + len(values) + 1]
        flat = np.frombuffer(values.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    else:
        flat = np.asarray(values.flatten().to_numpy(zero_copy_only=False))
    if values.null_count or flat.size % len(values) or flat.size and (_lengths(values) != flat.size // len(values)).any():
        raise ValueError("frames of one kernel call must be set and equally long")
    return flat.reshape(len(values), -1)


def _lengths(values: pa.Array) -> np.ndarray:
    """Length of every value; -1 for null."""
    measured = pc.binary_length(values) if pa.types.is_binary(values.type) else pc.list_value_length(values)
    return measured.fill_null(-1).to_numpy(zero_copy_only=False)


def _by_length(values: pa.Array, run: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """``run`` on the values of each length on their own, put back in their order; null stays null."""
    lengths = _lengths(values)
    kinds = np.unique(lengths)
    if len(kinds) <= 1 and not (kinds == -1).any():
        return run(values)
    places = [np.flatnonzero(lengths == k) for k in kinds]
    parts = [run(values.take(pa.array(at))) for k, at in zip(kinds, places) if k >= 0]
    kind = parts[0].type if parts else run(values.slice(0, 0)).type
    made = pa.concat_arrays([pa.nulls(len(at), kind) if k < 0 else parts.pop(0) for k, at in zip(kinds, places)])
    back = np.empty(len(values), dtype=np.int64)
    back[np.concatenate(places)] = np.arange(len(values))
    return made.take(pa.array(back))


def _result_type(element: str) -> pa.DataType:
    plain = pa.list_(pa.from_numpy_dtype(_DTYPES[element]))
    return pa.binary() if element == "bytes" else pa.list_(plain) if element == "rows" else plain


def _on_equal_lengths(fn: Callable[[np.ndarray], np.ndarray], element: str) -> Callable[[pa.Array], pa.Array]:
    """``fn`` on an Arrow array of equally long values."""
    dtype = _DTYPES[element]
    packed, nested = element == "bytes", element == "rows"

    def equal(values: pa.Array) -> pa.Array:
        if len(values) == 0:
            return pa.array([], type=_result_type(element))
        rows = _rows(values)
        step = max(SLICE // max(rows.shape[1], 1), 1)
        parts = [np.asarray(fn(rows[i : i + step]), dtype=dtype) for i in range(0, len(rows), step)]
        out = np.concatenate(parts)
        offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * out.shape[1])
        if packed:
            return pa.Array.from_buffers(
                pa.binary(), len(rows), [None, offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(out))]
            )
        flat = pa.array(out.ravel())
        if nested:
            inner = np.arange(out.shape[0] * out.shape[1] + 1, dtype=np.int32) * out.shape[2]
            flat = pa.ListArray.from_arrays(pa.array(inner), flat)
        return pa.ListArray.from_arrays(offsets, flat)

    return equal


def _sql_type(element: str) -> str:
    return {"bytes": "binary", "rows": "array<array<double>>"}.get(element, f"array<{element}>")


def batch_kernel(fn: Callable[[np.ndarray], np.ndarray], element: str = "double") -> Callable[[Column], Column]:
    """Column function applying ``fn`` (rows, width) -> (rows, other width) to a frame column.

    ``element`` names the result: ARRAY of double, int or boolean, packed ``bytes``, or ``rows`` for
    ARRAY<ARRAY<DOUBLE>> from a three-dimensional result.
    """
    equal = _on_equal_lengths(fn, element)

    @arrow_udf(_sql_type(element))
    def run(values: pa.Array) -> pa.Array:
        return _by_length(values, equal)

    return run


def guarded_kernel(fn: Callable[[np.ndarray], np.ndarray], element: str = "double") -> Callable[[Column], Column]:
    """``batch_kernel`` whose failures stay with the rows that cause them: a struct of ``value`` and ``error``.

    A batch on which ``fn`` fails is halved until the bad rows are alone; such a row has a null value and the failure's
    text, all others have what they would have without it. A null frame has a null struct.
    """
    equal, kind = _on_equal_lengths(fn, element), _result_type(element)

    def attempt(values: pa.Array) -> tuple[list[pa.Array], list[str | None]]:
        try:
            return [equal(values)], [None] * len(values)
        except Exception as e:  # noqa: BLE001 whatever a kernel raises is the row's
            if len(values) == 1:
                return [pa.nulls(1, kind)], [f"{type(e).__name__}: {e}"]
        half = len(values) // 2
        left, right = attempt(values.slice(0, half)), attempt(values.slice(half))
        return left[0] + right[0], left[1] + right[1]

    def both(values: pa.Array) -> pa.Array:
        parts, errors = attempt(values)
        return pa.StructArray.from_arrays([pa.concat_arrays(parts).cast(kind), pa.array(errors, pa.string())], names=["value", "error"])

    @arrow_udf(f"struct<value:{_sql_type(element)},error:string>")
    def run(values: pa.Array) -> pa.Array:
        return _by_length(values, both)

    return run


def pack() -> Callable[[Column], Column]:
    """Small non-negative integers of a frame as one byte each."""
    return batch_kernel(lambda rows: rows, "bytes")


def unpack() -> Callable[[Column], Column]:
    """A packed frame as ARRAY<INT>."""
    return batch_kernel(lambda rows: rows, "int")


def project(matrix: np.ndarray) -> Callable[[Column], Column]:
    """frame -> matrix @ frame."""
    turned = np.asarray(matrix, dtype=np.float64).T.copy()
    return batch_kernel(lambda rows: rows @ turned)
