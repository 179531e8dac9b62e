"""Small numpy kernels for work inside one frame or one bounded block, on batches of frames."""

from __future__ import annotations

import numpy as np


# Smoothing as matrices: out = left @ frame @ right.T --------------------------------------------


def mirror_matrix(size: int, weights: np.ndarray, repeat_edge: bool) -> np.ndarray:
    """Row i holds the weights of its neighbours, ends folded back.

    ``repeat_edge``: ``b a | a b c``; otherwise ``c b | a b c``.
    """
    radius = len(weights) // 2
    offsets = np.arange(-radius, radius + 1)
    place = np.arange(size)[:, None] + offsets[None, :]
    period = 2 * size if repeat_edge else max(2 * (size - 1), 1)
    turn = place % period
    folded = np.where(turn < size, turn, (2 * size - 1 if repeat_edge else 2 * (size - 1)) - turn)
    matrix = np.zeros((size, size))
    np.add.at(matrix, (np.repeat(np.arange(size), len(offsets)), folded.ravel()), np.tile(weights, size))
    return matrix


def gaussian(radius: int, sigma: float) -> np.ndarray:
    raw = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return raw / raw.sum()


def smooth_frames(frames: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.einsum("ij,bjk,lk->bil", left, frames, right, optimize=True)


def rotate_frames(frames: np.ndarray, degrees: np.ndarray) -> np.ndarray:
    """Each frame turned about its centre, bilinear, zero outside; pixel centres at half positions."""
    b, h, w = frames.shape
    angle = np.deg2rad(degrees)[:, None, None]
    v, u = np.meshgrid((2 * np.arange(h) + 1) / h - 1, (2 * np.arange(w) + 1) / w - 1, indexing="ij")
    x = ((np.cos(angle) * u - np.sin(angle) * v + 1) * w - 1) / 2
    y = ((np.sin(angle) * u + np.cos(angle) * v + 1) * h - 1) / 2
    x0, y0 = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
    fx, fy = x - x0, y - y0
    frame = np.arange(b)[:, None, None]

    def at(row: np.ndarray, col: np.ndarray) -> np.ndarray:
        inside = (row >= 0) & (row < h) & (col >= 0) & (col < w)
        return np.where(inside, frames[frame, np.clip(row, 0, h - 1), np.clip(col, 0, w - 1)], 0.0)

    top = at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx
    low = at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx
    return top * (1 - fy) + low * fy


# Thresholds -------------------------------------------------------------------------------------


def histograms(rows: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts per row and bin over the row's own range, with the range."""
    low, high = rows.min(axis=1), rows.max(axis=1)
    span = np.where(high > low, high - low, 1.0)
    place = np.minimum(np.floor((rows - low[:, None]) / span[:, None] * bins), bins - 1).astype(np.int64)
    flat = place + np.arange(len(rows))[:, None] * bins
    counts = np.bincount(flat.ravel(), minlength=len(rows) * bins).reshape(len(rows), bins)
    return counts, low, high


def otsu_thresholds(rows: np.ndarray, bins: int = 256) -> np.ndarray:
    """Bin centre with the greatest between-class variance; 0.5 for a uniform row."""
    counts, low, high = histograms(rows, bins)
    weight = counts.cumsum(axis=1).astype(float)
    moment = (counts * np.arange(bins)).cumsum(axis=1).astype(float)
    w2, s2 = weight[:, -1:] - weight, moment[:, -1:] - moment
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (moment * w2 - s2 * weight) ** 2 / (weight * w2)
    best = np.where(w2 * weight > 0, between, -1.0).argmax(axis=1)
    return np.where(high > low, low + (best + 0.5) * (high - low) / bins, 0.5)


def multi_otsu_thresholds(rows: np.ndarray, classes: int, bins: int) -> np.ndarray:
    """classes - 1 thresholds maximising the summed squared class moments over class weights.

    Dynamic programming over the histogram: the best value of k classes from bin b on extends the best of k - 1 classes from a later bin.
    The best split never moves back as b grows, so each half of the starts is searched between the splits of the starts around it
    (divide and conquer), for all rows at once: a row takes bins * log(bins) looks and no table of bins x bins. Ties (to 9 decimals) take
    the smallest thresholds. Rows that occupy fewer bins than classes get uniform thresholds.
    """
    counts, low, high = histograms(rows, bins)
    out = np.linspace(low, high, classes + 1, axis=1)[:, 1:-1]
    full = np.flatnonzero((counts > 0).sum(axis=1) >= classes)
    if not len(full):
        return out
    counts, n = counts[full], len(full)
    zero = np.zeros((n, 1))
    weight = np.concatenate([zero, counts.cumsum(axis=1)], axis=1)
    moment = np.concatenate([zero, (counts * np.arange(bins)).cumsum(axis=1)], axis=1)

    def value(row: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of the class of bins i..j; a class without pixels is no class."""
        w, s = weight[row, j + 1] - weight[row, i], moment[row, j + 1] - moment[row, i]
        return np.where(w > 0, s * s / np.where(w > 0, w, 1.0), -np.inf)

    every = np.arange(n)
    # after[:, b]: best value of the classes still to place when they start at bin b; none fits behind the last bin.
    after = np.full((n, bins + 1), -np.inf)
    after[:, :bins] = value(every[:, None], np.arange(bins)[None, :], np.full((1, bins), bins - 1))
    choices = []
    for _ in range(classes - 1):
        best, pick = np.full((n, bins + 1), -np.inf), np.full((n, bins), bins - 1)
        spans = [(0, bins - 1, None, None)]
        while spans:
            below = []
            for first, last, left, right in spans:
                middle = (first + last) // 2
                begin = np.maximum(pick[:, left] if left is not None else 0, middle) + np.zeros(n, np.int64)
                end = np.maximum(pick[:, right] if right is not None else bins - 1, begin) + np.zeros(n, np.int64)
                size = end - begin + 1
                starts = np.cumsum(size) - size
                row = np.repeat(every, size)
                j = np.arange(size.sum()) - np.repeat(starts - begin, size)
                total = np.round(value(row, np.full(len(j), middle), j) + after[row, j + 1], 9)
                top = np.maximum.reduceat(total, starts)
                hit = np.flatnonzero(total == np.repeat(top, size))
                at = hit[np.searchsorted(hit, starts)]
                # A start from which not all classes can be placed has no split; those before it may split anywhere.
                pick[:, middle], best[:, middle] = np.where(np.isfinite(top), j[at], bins - 1), top
                if first < middle:
                    below.append((first, middle - 1, left, middle))
                if middle < last:
                    below.append((middle + 1, last, middle, right))
            spans = below
        after = best
        choices.append(pick)
    start, picked = np.zeros(n, np.int64), []
    for pick in reversed(choices):
        picked.append(pick[every, start])
        start = np.minimum(picked[-1] + 1, bins - 1)
    out[full] = low[full, None] + (np.stack(picked, axis=1) + 0.5) * (high - low)[full, None] / bins
    return out


# Regions: masks of shape (batch, height, width) --------------------------------------------------


def _neighbours(connectivity: int) -> list[tuple[int, int]]:
    straight = [(-1, 0), (1, 0), (0, -1), (0, 1)]
    return straight if connectivity == 4 else straight + [(-1, -1), (-1, 1), (1, -1), (1, 1)]


def shifted(frames: np.ndarray, dy: int, dx: int, fill) -> np.ndarray:
    """frames moved so that out[y, x] = frames[y + dy, x + dx]."""
    out = np.full_like(frames, fill)
    h, w = frames.shape[1:]
    if abs(dy) >= h or abs(dx) >= w:
        return out
    ys, yd = slice(max(dy, 0), h + min(dy, 0)), slice(max(-dy, 0), h + min(-dy, 0))
    xs, xd = slice(max(dx, 0), w + min(dx, 0)), slice(max(-dx, 0), w + min(-dx, 0))
    out[:, yd, xd] = frames[:, ys, xs]
    return out


def label_regions(masks: np.ndarray, connectivity: int = 8) -> np.ndarray:
    """Each region gets 1 + the row-major index of its first pixel; background is 0."""
    b, h, w = masks.shape
    far = h * w + 1
    label = np.where(masks, np.arange(1, h * w + 1).reshape(1, h, w), far)
    while True:
        least = label
        for dy, dx in _neighbours(connectivity):
            least = np.minimum(least, shifted(label, dy, dx, far))
        least = np.where(masks, least, far)
        # Follow each label to its own pixel's label: distances halve instead of shrinking by one.
        flat = np.concatenate([least.reshape(b, -1), np.full((b, 1), far)], axis=1)
        least = np.take_along_axis(flat, flat[:, :-1] - 1, axis=1).reshape(b, h, w)
        if np.array_equal(least, label):
            return np.where(masks, label, 0)
        label = least


def region_sizes(labels: np.ndarray) -> np.ndarray:
    """Sizes by label (batch, height * width + 1); background counts 0."""
    b, width = len(labels), labels[0].size + 1
    flat = labels.reshape(b, -1) + np.arange(b)[:, None] * width
    sizes = np.bincount(flat.ravel(), minlength=b * width).reshape(b, width)
    sizes[:, 0] = 0
    return sizes


def drop_small(masks: np.ndarray, min_area: int, connectivity: int = 4) -> np.ndarray:
    """Remove regions with fewer than ``min_area`` pixels."""
    labels = label_regions(masks, connectivity)
    sizes = np.take_along_axis(region_sizes(labels), labels.reshape(len(labels), -1), axis=1)
    return masks & (sizes.reshape(masks.shape) >= min_area)


def largest_region(masks: np.ndarray, connectivity: int = 8) -> np.ndarray:
    """Keep the largest region (the first on ties); a mask without regions stays empty."""
    labels = label_regions(masks, connectivity)
    best = region_sizes(labels).argmax(axis=1)
    return masks & (labels == best[:, None, None])


def fill_holes(masks: np.ndarray) -> np.ndarray:
    """Background that no straight path joins to the border becomes foreground."""
    outside = np.pad(~masks, ((0, 0), (1, 1), (1, 1)), constant_values=True)
    reached = label_regions(outside, 4)
    return ~(reached[:, 1:-1, 1:-1] == 1)


def close_disk(masks: np.ndarray, radius: int) -> np.ndarray:
    """Dilation then erosion with a disk; nothing outside the frame counts in either step."""
    span = range(-radius, radius + 1)
    disk = [(dy, dx) for dy in span for dx in span if dy * dy + dx * dx <= radius * radius]
    grown = np.zeros_like(masks)
    for dy, dx in disk:
        grown |= shifted(masks, dy, dx, False)
    kept = np.ones_like(masks)
    for dy, dx in disk:
        kept &= shifted(grown, dy, dx, True)
    return kept


# Series blocks ----------------------------------------------------------------------------------

def sliding_dot(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Dot product of the weights with every full window of each row, summed in the same order at every place."""
    taps, width = len(weights), rows.shape[1]
    out = np.zeros((len(rows), width - taps + 1))
    for k, w in enumerate(weights):
        out += w * rows[:, k : k + width - taps + 1]
    return out


# Audio ------------------------------------------------------------------------------------------


def hann(n: int) -> np.ndarray:
    """Periodic Hann window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def mel_points(low: float, high: float, count: int) -> np.ndarray:
    """Frequencies evenly spaced on the mel scale: linear to 1 kHz, logarithmic above."""
    step, corner, log_step = 200.0 / 3, 1000.0, np.log(6.4) / 27.0

    def to_mel(f: float) -> float:
        return f / step if f < corner else corner / step + np.log(f / corner) / log_step

    mels = np.linspace(to_mel(low), to_mel(high), count)
    return np.where(mels < corner / step, mels * step, corner * np.exp(log_step * (mels - corner / step)))


def mel_filters(rate: float, n_fft: int, n_mels: int, low: float = 0.0, high: float | None = None) -> np.ndarray:
    """Triangles over the FFT bins (n_mels, n_fft // 2 + 1), each with area one in Hz."""
    bins = np.arange(n_fft // 2 + 1) * rate / n_fft
    edges = mel_points(low, rate / 2 if high is None else high, n_mels + 2)
    left, mid, right = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    rising, falling = (bins - left) / (mid - left), (right - bins) / (right - mid)
    return np.maximum(0.0, np.minimum(rising, falling)) * (2.0 / (right - left))


def dct_matrix(n_out: int, n_in: int) -> np.ndarray:
    """Orthonormal DCT-II rows."""
    k = np.arange(n_out)[:, None]
    basis = np.cos(np.pi * k * (2 * np.arange(n_in) + 1) / (2 * n_in)) * np.sqrt(2.0 / n_in)
    basis[0] /= np.sqrt(2.0)
    return basis


def spectrum_rows(n_fft: int, hop: int, frames: int, power: float, filters: np.ndarray | None = None):
    """Kernel: padded sample rows -> |rfft|**power of each windowed frame (rows, frames, bands)."""
    window = hann(n_fft)
    turned = None if filters is None else filters.T.copy()

    def run(rows: np.ndarray) -> np.ndarray:
        cut = np.lib.stride_tricks.sliding_window_view(rows, n_fft, axis=1)[:, ::hop][:, :frames]
        energy = np.abs(np.fft.rfft(cut * window, axis=2)) ** power
        if turned is not None:
            energy = energy @ turned
        return energy

    return run


def _mean_place(counts: np.ndarray, size: int) -> np.ndarray:
    """Mean index weighted by counts (batch, size), as a share of the size; 0 without pixels."""
    n = counts.sum(axis=1)
    return (counts @ np.arange(size)) / np.maximum(n, 1) / size


def _extent(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First occupied index and last minus first, as shares of the size; 0 without pixels."""
    held = counts > 0
    first = held.argmax(axis=1)
    last = size - 1 - held[:, ::-1].argmax(axis=1)
    some = held.any(axis=1)
    return np.where(some, first, 0) / size, np.where(some, last - first, 0) / size


def mask_geometry(masks: np.ndarray, tongue: int, jaw: int, lips: int) -> np.ndarray:
    """The 14 parameters (batch, 14) of masks (batch, height, width)."""
    b, h, w = masks.shape
    is_tongue = masks == tongue
    t_rows, t_cols = is_tongue.sum(axis=2), is_tongue.sum(axis=1)
    j_rows, l_rows, any_rows = ((m.sum(axis=2)) for m in (masks == jaw, masks == lips, masks > 0))
    n = t_rows.sum(axis=1)
    # Rows that begin at or before rank floor(0.2 (n - 1)) hold the points up to the 20th percentile.
    before = t_rows.cumsum(axis=1) - t_rows
    top = np.where(before <= np.floor(0.2 * (n - 1))[:, None], t_rows, 0)
    tip, _ = _extent(t_rows, h)
    _, width = _extent(t_cols, w)
    _, opening = _extent(j_rows, h)
    _, aperture = _extent(l_rows, h)
    occupied = np.where(any_rows > 0, any_rows, w + 1)
    narrow = occupied.argmin(axis=1)
    some = any_rows.any(axis=1)
    return np.stack(
        [
            n / (h * w), _mean_place(t_cols, w), _mean_place(t_rows, h), tip, _mean_place(top, h), width,
            j_rows.sum(axis=1) / (h * w), _mean_place(j_rows, h), opening,
            l_rows.sum(axis=1) / (h * w), _mean_place(l_rows, h), aperture,
            np.where(some, occupied[np.arange(b), narrow], 0) / w, np.where(some, narrow, 0) / h,
        ],
        axis=1,
    )
