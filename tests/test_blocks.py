"""Block tables of series: equal results whatever the block length, and whole or spread."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.brute import analytic_magnitude
from tests.test_scale import by_utt, series_df
from vocalgrid.operators import blocks, jobs, series

KEYS = ["utt"]


@pytest.fixture(scope="module")
def data(spark):
    return series_df(spark, {1: 700, 2: 64, 3: 1, 4: 129, 5: 2})


def rows(df, value="v", span=blocks.SPAN):
    return by_utt(blocks.to_rows(df, KEYS, "i", value, "out", span), "i", "out")


@pytest.mark.parametrize("span", [64, 128, 4096])
@pytest.mark.parametrize("most", [0, 100, 1 << 20])
def test_transforms_whole_and_spread_are_equal(data, span, most):
    values, df = data
    held = blocks.from_rows(df.withColumn("w", F.col("v") * F.col("v")), KEYS, "i", ["v", "w"], span)
    got = rows(blocks.magnitude(held, KEYS, "v", span, most), span=span)
    products = {(r["utt"], r["lag"]): r["total"] for r in blocks.lag_products(held, KEYS, "v", "w", span, most).collect()}
    lengths = held.groupBy("utt").agg((F.max("_n") + 3).alias("length"))
    best = {r["utt"]: (r["lag"], r["correlation"]) for r in blocks.best_correlation(held.select("utt", "_q", "_n", "v"), held.select("utt", "_q", "_n", "w"), KEYS, "v", "w", lengths, span, most).collect()}
    for u, x in values.items():
        assert np.allclose(got[u], analytic_magnitude(x))
        want = np.correlate(x, x * x, "full")
        assert np.allclose([products[u, k] for k in range(1 - len(x), len(x))], want)
        n = len(x) + 3
        lags = np.arange(-(n // 2), n - n // 2)
        share = np.array([want[k + len(x) - 1] if abs(k) < len(x) else 0.0 for k in lags]) / n
        assert best[u] == (lags[share.argmax()], pytest.approx(share.max(), abs=1e-10))


@pytest.mark.parametrize("span,radius", [(64, 5), (64, 64), (128, 100), (4096, 300)])
def test_smoothing_reaches_into_neighbours(data, span, radius):
    values, df = data
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / (radius / 4)) ** 2)
    weights /= weights.sum()
    got = rows(blocks.smoothed(blocks.from_rows(df, KEYS, "i", ["v"], span), KEYS, "v", weights), span=span)
    for u, x in values.items():
        assert np.allclose(got[u], np.convolve(np.pad(x, radius, mode="symmetric"), weights, "valid"))


def test_scaling(data):
    values, df = data
    held = blocks.minmax(blocks.from_rows(df, KEYS, "i", ["v"], 64), KEYS, "v")
    low, z = rows(held, span=64), rows(blocks.zscore(held, KEYS, "v"), span=64)
    for u, x in values.items():
        want = (x - x.min()) / (x.max() - x.min() + 1e-8)
        assert np.allclose(low[u], want) and np.allclose(z[u], (want - want.mean()) / (want.std() + 1e-8))


@pytest.mark.parametrize("source,target", [(10.0, 37.0), (50.0, 8.0), (3.0, 3.0)])
def test_resampling(spark, data, source, target):
    values, df = data
    counts = {u: int(len(x) / source * target) + 5 for u, x in values.items()}
    targets = spark.createDataFrame(list(counts.items()), "utt long, n_targets long")
    got = rows(blocks.resampled(blocks.from_rows(df, KEYS, "i", ["v"], 64), KEYS, "v", source, target, targets, 64, 128), span=128)
    for u, x in values.items():
        assert np.allclose(got[u], np.interp(np.arange(counts[u]) / target, np.arange(len(x)) / source, x, right=0.0))


def test_pieces_become_blocks(spark):
    made = blocks.reblocked(spark.createDataFrame([(1, 0, [0.0] * 3), (1, 3, [1.0] * 10), (1, 13, [2.0]), (2, 0, [])], "utt long, s long, v array<double>"), KEYS, "s", ["v"], 4)
    assert [(r["_q"], r["v"]) for r in made.orderBy("_q").collect()] == [(0, [0.0] * 3 + [1.0]), (1, [1.0] * 4), (2, [1.0] * 4), (3, [1.0, 2.0])]


def test_a_real_utterance_aligns_within_seconds(spark):
    """37 s at 22,050 Hz beside 3,100 frames, the audio a quarter of a second late, given in arrays of one second."""
    fps, rate, seconds = 83.28, 22050, 37
    r = np.random.default_rng(0)
    beat = np.convolve(r.random(int(seconds * fps)), np.ones(9) / 9, "same")
    level = np.cumsum(np.where(np.arange(len(beat)) % 2, 1, -1) * beat)
    images = spark.createDataFrame([("u", i, [float(v)]) for i, v in enumerate(level)], "utt string, i long, px array<double>")
    late = rate // 4
    t = np.arange(seconds * rate) - late
    sound = np.interp(t / rate, np.arange(len(beat)) / fps, beat) * np.sin(2 * np.pi * 440 * t / rate)
    audio = spark.createDataFrame([("u", k * rate, sound[k * rate : (k + 1) * rate].tolist()) for k in range(seconds)], "utt string, i long, v array<double>")
    start = time.time()
    got = jobs.align(images, audio, ["utt"], "i", "px", "v", fps, float(rate), 10.0).first()
    assert time.time() - start < 60 and got["n_samples"] == seconds * rate
    assert abs(got["offset_samples"] - late) < rate / fps * 2 and got["correlation"] > 0.5


def test_empty_series(spark):
    none = spark.createDataFrame([], "utt long, i long, v double")
    held = blocks.from_rows(none.withColumn("w", F.col("v")), KEYS, "i", ["v", "w"])
    assert blocks.magnitude(held, KEYS, "v").count() == 0 and blocks.lag_products(held, KEYS, "v", "w").count() == 0
    assert series.gaussian_smooth(none, KEYS, "i", "v", 50.0, 40.0).count() == 0
