"""Numpy kernels against brute force."""

from itertools import combinations

import numpy as np
import pytest

from vocalgrid.functions import kernels


def walk(mask, connectivity):
    h, w = mask.shape
    label = np.zeros((h, w), int)
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (connectivity == 8 or abs(a) + abs(b) == 1)]
    for y in range(h):
        for x in range(w):
            if mask[y, x] and not label[y, x]:
                name, todo = y * w + x + 1, [(y, x)]
                label[y, x] = name
                while todo:
                    cy, cx = todo.pop()
                    for dy, dx in steps:
                        ny, nx = cy + dy, cx + dx
                        if 0 <= ny < h and 0 <= nx < w and mask[ny, nx] and not label[ny, nx]:
                            label[ny, nx] = name
                            todo.append((ny, nx))
    return label


@pytest.mark.parametrize("connectivity", [4, 8])
def test_regions(connectivity):
    masks = np.random.default_rng(0).random((40, 11, 9)) < np.linspace(0.2, 0.8, 40)[:, None, None]
    got = kernels.label_regions(masks, connectivity)
    for m, g in zip(masks, got):
        assert np.array_equal(walk(m, connectivity), g)


def test_spiral_region_is_one():
    mask = np.ones((21, 21), bool)
    for k in range(1, 10, 2):
        mask[k, k - 1 : 21 - k] = False
        mask[k : 21 - k, 20 - k] = False
        mask[20 - k, k + 1 : 21 - k] = False
        mask[k + 2 : 21 - k, k] = False
    got = kernels.label_regions(mask[None], 4)[0]
    assert np.array_equal(got, walk(mask, 4))


def test_small_regions_and_largest():
    mask = np.zeros((1, 6, 6), bool)
    mask[0, 0, :2] = mask[0, 2, :3] = mask[0, 5, 3:] = True
    assert kernels.drop_small(mask, 3).sum() == 6
    best = kernels.largest_region(mask)
    assert best[0, 2, :3].all() and best.sum() == 3  # the first of two equal ones
    assert not kernels.largest_region(np.zeros((1, 4, 4), bool)).any()


def test_holes_and_closing():
    ring = np.zeros((1, 7, 7), bool)
    ring[0, 1:6, 1:6] = True
    ring[0, 2:5, 2:5] = False
    assert kernels.fill_holes(ring)[0, 1:6, 1:6].all() and kernels.fill_holes(ring).sum() == 25
    gap = np.ones((1, 9, 9), bool)
    gap[0, 4, 4] = False
    assert kernels.close_disk(gap, 3).all()


def test_otsu_separates_two_levels():
    rng = np.random.default_rng(1)
    rows = np.concatenate([rng.normal(0.2, 0.02, (5, 60)), rng.normal(0.8, 0.02, (5, 40))], axis=1)
    t = kernels.otsu_thresholds(rows, 256)
    # The threshold is the centre of the last low bin: half a bin above it the levels are apart.
    half = (rows.max(axis=1) - rows.min(axis=1)) / 512
    assert ((rows > (t + half + 1e-9)[:, None]).sum(axis=1) == 40).all()
    assert kernels.otsu_thresholds(np.full((1, 9), 0.3))[0] == 0.5


@pytest.mark.parametrize("classes", [3, 4])
def test_multi_otsu_equals_listing(classes):
    bins = 12
    rows = np.random.default_rng(2).random((25, 40))
    got = kernels.multi_otsu_thresholds(rows, classes, bins)
    counts, low, high = kernels.histograms(rows, bins)
    for r in range(len(rows)):
        best = -1.0
        for cut in combinations(range(bins - 1), classes - 1):
            edges = [-1, *cut, bins - 1]
            parts = [counts[r, a + 1 : b + 1] for a, b in zip(edges, edges[1:])]
            if any(p.sum() == 0 for p in parts):
                continue
            value = sum((p @ np.arange(a + 1, b + 1)) ** 2 / p.sum() for p, a, b in zip(parts, edges, edges[1:]))
            if value > best + 1e-9:
                best, pick = value, cut
        assert np.allclose(got[r], low[r] + (np.array(pick) + 0.5) * (high[r] - low[r]) / bins)
    assert np.allclose(kernels.multi_otsu_thresholds(np.array([[0.0, 1.0, 1.0, 0.0]]), 3, bins)[0], [1 / 3, 2 / 3])


def test_mel_bank_and_dct():
    bank = kernels.mel_filters(16000, 512, 40)
    assert bank.shape == (40, 257) and (bank >= 0).all()
    assert np.allclose(kernels.mel_points(0, 1000, 16), np.linspace(0, 1000, 16))
    high = kernels.mel_points(1000, 6400, 28)
    assert np.allclose(high[1:] / high[:-1], 6.4 ** (1 / 27))
    # Area one: a fine grid sums to 1 over the bin width.
    fine = kernels.mel_filters(16000, 1 << 16, 20)
    assert np.allclose(fine.sum(axis=1) * 16000 / (1 << 16), 1.0, atol=1e-3)
    square = kernels.dct_matrix(8, 8)
    assert np.allclose(square @ square.T, np.eye(8))


def test_mirror_matrix_rows_sum_to_one():
    for repeat in (True, False):
        m = kernels.mirror_matrix(3, kernels.gaussian(5, 1.5), repeat)
        assert np.allclose(m.sum(axis=1), 1.0)
    assert np.allclose(kernels.mirror_matrix(4, np.array([0.0, 0.0, 1.0]), False) @ np.arange(4), [1, 2, 3, 2])
    assert np.allclose(kernels.mirror_matrix(4, np.array([0.0, 0.0, 1.0]), True) @ np.arange(4), [1, 2, 3, 3])


def test_rotation():
    frames = np.random.default_rng(4).random((2, 9, 9))
    assert np.allclose(kernels.rotate_frames(frames, np.zeros(2)), frames)
    quarter = kernels.rotate_frames(frames, np.full(2, 90.0))
    assert np.allclose(quarter, np.rot90(frames, 1, axes=(1, 2))) or np.allclose(quarter, np.rot90(frames, -1, axes=(1, 2)))


def test_geometry_equals_definition():
    masks = np.random.default_rng(5).integers(0, 4, (30, 10, 12))
    masks[0] = 0
    masks[1] = np.where(masks[1] == 1, 0, masks[1])
    got = kernels.mask_geometry(masks, 1, 2, 3)
    for m, g in zip(masks, got):
        y, x = np.where(m == 1)
        want = [0.0] * 6
        if len(y):
            top = y[y <= np.percentile(y, 20)]
            want = [len(y) / 120, x.mean() / 12, y.mean() / 10, y.min() / 10, top.mean() / 10, (x.max() - x.min()) / 12]
        for c in (2, 3):
            y = np.where(m == c)[0]
            want += [len(y) / 120, y.mean() / 10, (y.max() - y.min()) / 10] if len(y) else [0.0] * 3
        widths = (m > 0).sum(axis=1)
        rows = np.where(widths > 0)[0]
        want += [widths[rows].min() / 12, rows[widths[rows].argmin()] / 10] if len(rows) else [0.0, 0.0]
        assert np.allclose(g, want)


@pytest.mark.parametrize("taps", [5, 301])
def test_sliding_dot_both_ways(taps):
    rng = np.random.default_rng(6)
    rows, w = rng.normal(size=(3, 700)), rng.normal(size=taps)
    want = np.stack([np.correlate(r, w, "valid") for r in rows])
    assert np.allclose(kernels.sliding_dot(rows, w), want)


def test_frames_of_mixed_sizes_and_nulls_keep_their_own_rows(spark):
    from vocalgrid.functions.arrow import batch_kernel

    data = [(0, [1.0, 2.0]), (1, [1.0, 2.0, 3.0, 4.0]), (2, None), (3, [5.0, 6.0]), (4, [])]
    df = spark.createDataFrame(data, "i int, a array<double>").coalesce(1)
    doubled = batch_kernel(lambda rows: rows * 2)
    got = {r["i"]: r["b"] for r in df.select("i", doubled("a").alias("b")).collect()}
    assert got == {0: [2.0, 4.0], 1: [2.0, 4.0, 6.0, 8.0], 2: None, 3: [10.0, 12.0], 4: []}
    packed = batch_kernel(lambda rows: rows, "int")
    bins = spark.createDataFrame([(0, bytearray(b"\x01\x02")), (1, bytearray(b"\x01\x02\x03\x04"))], "i int, a binary").coalesce(1)
    assert {r["i"]: r["b"] for r in bins.select("i", packed("a").alias("b")).collect()} == {0: [1, 2], 1: [1, 2, 3, 4]}


def test_nan_is_never_good(spark):
    from pyspark.sql import functions as F

    from vocalgrid.functions import columns as C

    row = spark.range(1).select(
        C.quality_tier(F.lit(float("nan"))).alias("tier"), C.fixed_point(F.lit(float("nan")), 3).alias("nan"), C.fixed_point(F.lit(float("-inf")), 2).alias("inf"),
        C.alignment_is_valid(F.lit(float("nan")), F.lit(0.0), F.lit(100), 0.1).alias("ok"),
    ).first()
    assert tuple(row) == (C.fixed.LOWEST_TIER, "nan", "-inf", False)
