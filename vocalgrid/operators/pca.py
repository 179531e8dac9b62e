"""PCA parameters of label masks by block Lanczos steps: the covariance is applied to a few directions, never formed.

Each step is one pass over the frames: centred rows times a thin block, summed inside a task and then over tasks. What
reaches the driver is a basis of (steps * block) directions of P pixels, at most P * P values (as with k = P), and never a frame.

The start is a random block of 2k + 10 directions wider than k, so ``PASSES`` passes and the one for the mean, four scans in all, are enough for
all but flat spectra, whatever the number of frames and pixels. The steps end earlier when the wanted components satisfy their
equation to ``tolerance``, or span everything. The model says how far it is off: ``bound`` is the largest residual of a component, as a share of the greatest variance, and
no variance is further from a true one than that. With ``passes=None`` the steps go on until the tolerance holds: when ``max_steps`` blocks
are held, the basis is cut to its leading directions (thick restart); without an end after ``MAX_PASSES`` passes the fit raises.

Defined cases: null masks are left out of the fit and have null scores; masks of another size raise; constant masks give
components of no variance, whose shares are 0 and which whitening leaves as they are; no masks at all raise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from vocalgrid.functions.arrow import SLICE, _rows, batch_kernel, unpack

OVERSAMPLE = 10
PASSES = 3
MAX_STEPS = 12
MAX_PASSES = 2000
TOLERANCE = 1e-8
# Values of one summed piece, and the number of first sums per piece: both bound what a task holds.
PIECE = 1 << 14
SPREAD = 64


@dataclass
class MaskPCA:
    """A fitted model: mean (P), components (k, P), variance of each and of all pixels, frame shape, whitening."""

    mean: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    total: float
    height: int
    width: int
    whiten: bool = False
    bound: float = 0.0

    @property
    def explained_ratio(self) -> np.ndarray:
        return self.variances / self.total if self.total > 0 else np.zeros_like(self.variances)


def _shape_text(height: int, width: int) -> str:
    return f"masks must hold {height} x {width} pixels"


def _summed(pieces: DataFrame) -> np.ndarray:
    """Sum of vectors given as rows (piece, values), first by ``SPREAD`` parts of each piece and then over these."""

    def add(group):
        total = group["values"].iloc[0].copy()
        for more in group["values"].iloc[1:]:
            total += more
        return pd.DataFrame({"piece": group["piece"].iloc[:1], "values": [total]})

    kind = "piece int, values array<double>"
    first = pieces.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(SPREAD)))
    parts = first.groupBy("piece", "part").applyInPandas(add, kind)
    rows = parts.groupBy("piece").applyInPandas(add, kind).orderBy("piece").toPandas()
    return np.concatenate(rows["values"].to_list())


def _applied(frames: DataFrame, mean: np.ndarray, block: np.ndarray, shape: str) -> np.ndarray:
    """Sum over frames of centred frame times (centred frame times ``block``): pixels x block width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(block)
        for batch in batches:
            if len(batch):
                rows = _rows(batch.column(0))
                if rows.shape[1] != len(mean):
                    raise ValueError(shape)
                step = max(SLICE // len(mean), 1)
                for at in range(0, len(rows), step):
                    part = rows[at : at + step] - mean
                    total += part.T @ (part @ block)
        flat = total.ravel()
        for piece, at in enumerate(range(0, len(flat), PIECE)):
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([flat[at : at + PIECE]], pa.list_(pa.float64()))], names=["piece", "values"])

    return _summed(frames.mapInArrow(run, "piece int, values array<double>")).reshape(block.shape)


def _orthonormal(block: np.ndarray, basis: np.ndarray, floor: float) -> np.ndarray:
    """What ``block`` adds to the span of ``basis``: orthonormal columns, those under ``floor`` left out."""
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    left, size, _ = np.linalg.svd(block, full_matrices=False)
    fresh = left[:, size > floor]
    fresh = fresh - basis @ (basis.T @ fresh)
    return np.linalg.qr(fresh)[0]


def fit(
    df: DataFrame, mask: str, height: int, width: int, k: int = 10, whiten: bool = False,
    max_steps: int = MAX_STEPS, tolerance: float = TOLERANCE, seed: int = 5, passes: int | None = PASSES,
) -> MaskPCA:
    """The ``k`` components of greatest variance; the largest loading of each is positive."""
    pixels, shape = height * width, _shape_text(height, width)
    if k > pixels:
        raise ValueError(f"{k} components of {pixels} pixels")
    column = unpack()(F.col(mask)) if isinstance(df.schema[mask].dataType, BinaryType) else F.col(mask)
    frames = df.where(F.col(mask).isNotNull()).select(column.cast("array<double>").alias("x"))
    if frames.isEmpty():
        raise ValueError("no masks to fit")
    found = frames.select(Summarizer.metrics("mean", "variance", "count").summary(array_to_vector("x")).alias("s")).select("s.*").first()
    mean, count = found["mean"].toArray(), found["count"]
    if len(mean) != pixels:
        raise ValueError(shape)
    total = float(found["variance"].toArray().sum()) if count > 1 else 0.0

    start = np.random.default_rng(seed).standard_normal((pixels, min(pixels, 3 * k + OVERSAMPLE)))
    block = np.linalg.qr(start)[0]
    basis, images = np.zeros((pixels, 0)), np.zeros((pixels, 0))
    for done in range(1, MAX_PASSES + 1 if passes is None else passes + 1):
        image = _applied(frames, mean, block, shape) / max(count - 1, 1)
        basis, images = np.hstack([basis, block]), np.hstack([images, image])
        inner = basis.T @ images
        values, turns = np.linalg.eigh((inner + inner.T) / 2)
        values, every = values[::-1][:k], turns[:, ::-1]
        turns = every[:, :k]
        gap = np.linalg.norm(images @ turns - (basis @ turns) * values, axis=0).max()
        floor = tolerance * max(values[0], 0.0)
        if gap <= floor or done == passes:
            break
        block = _orthonormal(image, basis, floor)
        if not block.shape[1]:
            gap = 0.0
            break
        if basis.shape[1] + block.shape[1] > max(max_steps, 3) * start.shape[1]:
            # The residuals of all kept directions lie in the new block, so nothing that was found is lost.
            kept = every[:, : 2 * start.shape[1]]
            basis, images = basis @ kept, images @ kept
    else:
        raise RuntimeError(f"components not found to {tolerance:g} in {MAX_PASSES} passes")
    rows = (basis @ turns).T
    lead = np.abs(rows).argmax(axis=1)
    rows = rows * np.where(rows[np.arange(k), lead] < 0, -1.0, 1.0)[:, None]
    return MaskPCA(mean, rows, np.maximum(values, 0.0), total, height, width, whiten, float(gap / values[0]) if values[0] > 0 else 0.0)


def _scale(model: MaskPCA) -> np.ndarray:
    kept = model.variances > TOLERANCE * max(model.total, 0.0)
    return np.sqrt(np.where(kept, model.variances, 1.0)) if model.whiten else np.ones(len(model.variances))


def transform(model: MaskPCA, mask: Column) -> Column:
    """Component scores of a mask column: centred, projected, optionally whitened."""
    turned, mean = (model.components / _scale(model)[:, None]).T.copy(), model.mean
    shape = _shape_text(model.height, model.width)

    def run(rows: np.ndarray) -> np.ndarray:
        if rows.shape[1] != len(mean):
            raise ValueError(shape)
        return (rows - mean) @ turned

    return batch_kernel(run)(mask)


def inverse(model: MaskPCA, scores: Column, classes: bool = True) -> Column:
    """Masks from scores: projected back; with ``classes`` clipped to 0..3 and truncated to whole classes."""
    back, mean = model.components * _scale(model)[:, None], model.mean

    def run(rows: np.ndarray) -> np.ndarray:
        made = rows @ back + mean
        return np.floor(np.clip(made, 0.0, 3.0)) if classes else made

    return batch_kernel(run, "int" if classes else "double")(scores)


def explained_variance(spark: SparkSession, model: MaskPCA) -> DataFrame:
    """Share per component and in total (component null)."""
    rows = [(i, float(v)) for i, v in enumerate(model.explained_ratio)]
    table = spark.createDataFrame(rows, "component long, share double")
    return table.rollup("component").agg(F.sum("share").alias("share"))


def save(spark: SparkSession, model: MaskPCA, path: str) -> None:
    """One row for the mean (component null) and one per component; every row carries shape, whitening and total."""
    shared = (float(model.total), model.height, model.width, model.whiten)
    rows = [(None, None, model.mean.tolist(), *shared)]
    rows += [(i, float(v), c.tolist(), *shared) for i, (v, c) in enumerate(zip(model.variances, model.components))]
    kind = "component int, variance double, loadings array<double>, total double, height int, width int, whiten boolean"
    spark.createDataFrame(rows, kind).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> MaskPCA:
    mean, *rows = spark.read.parquet(path).orderBy(F.col("component").asc_nulls_first()).collect()
    return MaskPCA(
        np.array(mean["loadings"]), np.array([r["loadings"] for r in rows]), np.array([r["variance"] for r in rows]),
        mean["total"], mean["height"], mean["width"], mean["whiten"],
    )
