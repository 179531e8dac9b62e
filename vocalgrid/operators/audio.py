"""Spectral features of sampled series on the frame clock.

Samples are gathered into blocks of bounded length with the halo their frames need; one Arrow kernel
per block does windowing, FFT and filter banks. Utterance-wide values (peak level, noise
profile) are aggregations joined back by salted lookup.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType

from vocalgrid import fixed, scale
from vocalgrid.fixed import POWER_FLOOR, TOP_DB
from vocalgrid.functions import kernels
from vocalgrid.functions.arrow import batch_kernel
from vocalgrid.operators import blocks, series
from vocalgrid.session import pinned

FRAMES_PER_BLOCK = 64


def frame_spectrum(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    value: str,
    n_fft: int = 512,
    hop: int = 160,
    power: float = 2.0,
    filters: np.ndarray | None = None,
    out: str = "spectrum",
) -> DataFrame:
    """|FFT|**power of centred, zero-padded, Hann-windowed frames; 1 + n // hop frames per series.

    With ``filters`` (rows of weights over the bins) their weighted sums are returned instead. The
    value column holds one sample per row, or, far cheaper, blocks of ``FRAMES_PER_BLOCK * hop``
    samples with ``idx`` counting the blocks (``scale.to_blocks``).
    """
    half, span = n_fft // 2, FRAMES_PER_BLOCK * hop
    after = n_fft - half
    if max(half, after) > span:
        raise ValueError("frames must not be longer than a block of samples")
    if isinstance(df.schema[value].dataType, ArrayType):
        blocks = df.select(*keys, idx, F.col(value).cast("array<double>").alias("_x"))
        sizes = df.groupBy(*keys).agg(F.sum(F.size(value)).alias("n"))
    else:
        sizes = scale.group_size(df, keys)
        blocks = scale.to_blocks(df.select(*keys, idx, F.col(value).cast("double").alias("_x")), keys, idx, "_x", span)
    joined = scale.attach(scale.block_neighbours(blocks, keys, idx, "_x", half, after), sizes, keys, [idx])
    # A series of exactly b * span samples has one more frame, centred behind its last sample.
    joined = joined.where(F.col("_x").isNotNull() | (F.col(idx) * span == F.col("n")))
    width = (FRAMES_PER_BLOCK - 1) * hop + n_fft
    zero = F.lit(0.0)
    none = F.array().cast("array<double>")
    head, own, tail = (F.coalesce(F.col(c), none) for c in ("_head", "_x", "_tail"))
    # Missing samples are zero; samples beyond the last frame's window are cut.
    filled = F.concat(F.array_repeat(zero, half - F.size(head)), head, own, tail)
    padded = F.slice(F.concat(filled, F.array_repeat(zero, F.greatest(width - F.size(filled), F.lit(0)))), 1, width)
    kernel = batch_kernel(kernels.spectrum_rows(n_fft, hop, FRAMES_PER_BLOCK, power, filters), "rows")
    held = joined.select(*keys, (F.col(idx) * FRAMES_PER_BLOCK).alias("_f"), "n", kernel(padded).alias("_e"))
    framed = held.select(*keys, "_f", "n", F.posexplode("_e").alias("_j", out))
    framed = framed.withColumn("frame", (F.col("_f") + F.col("_j")).cast("long"))
    return framed.where(F.col("frame") <= F.floor(F.col("n") / hop)).select(*keys, "frame", out)


def mel_spectrum(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    value: str,
    rate: float,
    n_mels: int = 80,
    n_fft: int = 512,
    hop: int = 160,
    low: float = 0.0,
    high: float | None = None,
    power: float = 2.0,
) -> DataFrame:
    """Power per mel band and spectral frame."""
    bank = kernels.mel_filters(rate, n_fft, n_mels, low, high)
    return frame_spectrum(df, keys, idx, value, n_fft, hop, power, bank, out="mel")


def _sample_blocks(df: DataFrame, keys: Sequence[str], idx: str, value: str, span: int) -> DataFrame:
    """Block table of ``span`` samples from rows of samples, or from blocks of that length counted by ``idx``."""
    if isinstance(df.schema[value].dataType, ArrayType):
        return blocks.sized(df.select(*keys, F.col(idx).cast("long").alias("_q"), F.col(value).cast("array<double>").alias(value)), keys, value)
    return blocks.from_rows(df, keys, idx, [value], span)


def _bands(n_fft: int, hop: int, span: int, power: float, bank: np.ndarray) -> Callable[..., Column]:
    """Pass 1: packed band sums of the frames a block owns and of the first frame behind them, and the peak of each bank's own frames.

    ``bank`` holds the filters of all parts, one below the other.
    """
    window, turned = kernels.hann(n_fft), bank.T.copy()

    @arrow_udf("struct<bands:binary,peak:array<double>>")
    def run(head: pa.Array, own: pa.Array, tail: pa.Array, q: pa.Array, n: pa.Array) -> pa.Array:
        made, peaks = [], []
        for k in range(len(own)):
            x, before, _ = _joined(head, own, tail, k)
            start, size = q[k].as_py() * span, n[k].as_py()
            low, high = start // hop, min((start + span) // hop, size // hop)
            energy = np.abs(np.fft.rfft(_frames(x, start - before, low, high, n_fft, hop) * window, axis=1)) ** power @ turned
            made.append(energy.tobytes())
            peaks.append(energy[: span // hop if start + span < size else len(energy)].max(axis=0))
        return pa.StructArray.from_arrays([pa.array(made, pa.binary()), pa.array(peaks, pa.list_(pa.float64()))], names=["bands", "peak"])

    return run


def _levels(energy: np.ndarray, peak: float, kind: str, matrix: np.ndarray | None) -> np.ndarray:
    """Decibels below the peak, or cepstra of decibels; both reach down to 80 dB below the peak."""
    db = 10 * np.log10(np.maximum(energy, POWER_FLOOR))
    top = 10 * np.log10(max(peak, POWER_FLOOR))
    return np.maximum(db - top, -TOP_DB) if kind == "mel" else np.maximum(db, top - TOP_DB) @ matrix.T


def spectral_features(
    df: DataFrame, keys: Sequence[str], idx: str, value: str, rate: float, targets: DataFrame, fps: float, parts: dict[str, tuple[np.ndarray, np.ndarray | None]],
    n_fft: int = 512, hop: int = 160, power: float = 2.0,
) -> DataFrame:
    """Features of several kinds on the frame clock, from one spectrum: keys, frame_idx and an array per part.

    A part has a filter bank and, for cepstra, a matrix that its levels are turned by. Two passes over blocks of samples: the first
    transforms each block once for all parts and keeps band sums and peaks; the second, knowing the peak of the whole
    utterance, makes levels and interpolates them to the times j / fps, j = 0 .. n_frames-1. A block carries the first frame of
    the next one, so it answers for every time up to there alone; behind the last frame its values are held.
    """
    if hop * FRAMES_PER_BLOCK < n_fft:
        raise ValueError("frames must not be longer than a block of samples")
    on, span = list(keys), FRAMES_PER_BLOCK * hop
    names = list(parts)
    widths = np.cumsum([0, *[len(bank) for bank, _ in parts.values()]])
    bank = np.concatenate([b for b, _ in parts.values()])
    held = _sample_blocks(df, on, idx, value, span)
    met = scale.block_neighbours(held.select(*on, "_n", "_q", value), [*on, "_n"], "_q", value, n_fft, n_fft + hop).where(F.col(value).isNotNull())
    # Pinned, because the peak and the levels both read it.
    bands = pinned(met.select(*on, "_q", "_n", _bands(n_fft, hop, span, power, bank)("_head", value, "_tail", "_q", "_n").alias("_e")))
    tops = [F.max(F.array_max(F.slice("_e.peak", int(a) + 1, int(b - a)))) for a, b in zip(widths[:-1], widths[1:])]
    peaks = bands.groupBy(*on).agg(F.array(*tops).alias("_peak"))
    plan = peaks.join(targets.select(*on, F.col("n_frames").cast("long").alias("_m")), on)
    ready = scale.attach(bands, plan, on, ["_q"])
    fields = ",".join(f"p{k}:array<array<double>>" for k in range(len(names)))

    @arrow_udf(f"struct<start:bigint,stop:bigint,{fields}>")
    def run(packed: pa.Array, q: pa.Array, n: pa.Array, peak: pa.Array, most: pa.Array) -> pa.Array:
        starts, stops, made = [], [], [[] for _ in names]
        for k in range(len(packed)):
            energy = np.frombuffer(packed[k].as_py(), dtype=float).reshape(-1, widths[-1])
            first = q[k].as_py() * FRAMES_PER_BLOCK
            last = (q[k].as_py() + 1) * span >= n[k].as_py()
            times = np.arange(first, first + len(energy)) * float(hop) / rate
            low = max(int(times[0] * fps) - 1, 0)
            j = np.arange(low, min(int(np.ceil(times[-1] * fps)) + 2, most[k].as_py()))
            at = j / fps
            inside = (at >= times[0]) & ((at <= times[-1]) if last else (at < times[-1]))
            j, at = j[inside], at[inside]
            # The last block tells where its answers end; from there on its last frame is held.
            stop = int(j[-1]) + 1 if len(j) else int(np.ceil(times[-1] * fps))
            starts.append(int(j[0]) if len(j) else stop)
            stops.append(stop if last else None)
            here = np.clip(np.searchsorted(times, at, side="right") - 1, 0, max(len(times) - 2, 0))
            after = np.minimum(here + 1, len(times) - 1)
            share = np.divide(at - times[here], times[after] - times[here], out=np.zeros(len(at)), where=after > here)[:, None]
            for part, (a, b, (_, matrix)) in enumerate(zip(widths[:-1], widths[1:], parts.values())):
                level = _levels(energy[:, a:b], peak[k][part].as_py(), "mel" if matrix is None else "cepstra", matrix)
                rows = level[here] + (level[after] - level[here]) * share
                # The last frame goes along behind the answers of the last block.
                made[part].append(np.concatenate([rows, level[-1:]]) if last else rows)
        lists = [_nested(m) for m in made]
        return pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(stops, pa.int64()), *lists], names=["start", "stop", *[f"p{k}" for k in range(len(names))]])

    framed = ready.select(*on, "_m", run("_e.bands", "_q", "_n", "_peak", "_m").alias("_o"))
    zipped = F.arrays_zip(*[F.col(f"_o.p{k}") for k in range(len(names))])
    rows = framed.select(*on, "_m", F.col("_o.start").alias("_s"), F.col("_o.stop").alias("_z"), F.posexplode(zipped).alias("_j", "_v"))
    place = F.col("_s") + F.col("_j")
    values = [F.col("_v")[f"p{k}"].alias(name) for k, name in enumerate(names)]
    # Of the held frame one row was made; it stands for all frames behind the last time, which there may be none of.
    is_held = F.col("_z").isNotNull() & (place >= F.col("_z"))
    near = rows.where(~is_held).select(*on, place.alias("frame_idx"), *values)
    far = scale.explode_range(rows.where(is_held).select(*on, "_z", "_m", *values), F.col("_z"), F.col("_m"), "frame_idx")
    return near.unionByName(far.select(*on, "frame_idx", *names))


def _nested(rows: list[np.ndarray]) -> pa.Array:
    """Tables of numbers as array<array<double>> values."""
    flat = np.concatenate([r.ravel() for r in rows]) if rows else np.zeros(0)
    inner = np.concatenate([[0], *[np.full(len(r), r.shape[1]) for r in rows]]).cumsum()
    outer = np.concatenate([[0], [len(r) for r in rows]]).cumsum()
    return pa.ListArray.from_arrays(pa.array(outer, pa.int32()), pa.ListArray.from_arrays(pa.array(inner, pa.int32()), pa.array(flat)))


def mel_features(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    value: str,
    rate: float,
    targets: DataFrame,
    fps: float,
    n_mels: int = 80,
    n_fft: int = 512,
    hop: int = 160,
    low: float = 0.0,
    high: float | None = None,
    power: float = 2.0,
) -> DataFrame:
    """Mel bands in dB below the utterance's peak, on the frame clock; targets: keys, n_frames."""
    parts = {"mel": (kernels.mel_filters(rate, n_fft, n_mels, low, high), None)}
    return spectral_features(df, keys, idx, value, rate, targets, fps, parts, n_fft, hop, power)


def mfcc_features(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    value: str,
    rate: float,
    targets: DataFrame,
    fps: float,
    n_mfcc: int = 13,
    n_mels: int = 40,
    n_fft: int = 512,
    hop: int = 160,
    low: float = 0.0,
    high: float | None = None,
) -> DataFrame:
    """Cepstral coefficients of the mel bands in dB (reference 1, top 80 dB), on the frame clock."""
    parts = {"mfcc": (kernels.mel_filters(rate, n_fft, n_mels, low, high), kernels.dct_matrix(n_mfcc, n_mels))}
    return spectral_features(df, keys, idx, value, rate, targets, fps, parts, n_fft, hop)


def mel_and_mfcc(
    df: DataFrame, keys: Sequence[str], idx: str, value: str, rate: float, targets: DataFrame, fps: float, n_mels: int = 80, n_mfcc: int = 13, n_mfcc_mels: int = 40,
    n_fft: int = 512, hop: int = 160, low: float = 0.0, high: float | None = None,
) -> DataFrame:
    """Both of the above from one spectrum: keys, frame_idx, mel, mfcc."""
    parts = {
        "mel": (kernels.mel_filters(rate, n_fft, n_mels, low, high), None),
        "mfcc": (kernels.mel_filters(rate, n_fft, n_mfcc_mels, low, high), kernels.dct_matrix(n_mfcc, n_mfcc_mels)),
    }
    return spectral_features(df, keys, idx, value, rate, targets, fps, parts, n_fft, hop)


def _noise_end(n: Column, rate: float, noise_seconds: float) -> Column:
    """Samples of the noise sample at the start: ``noise_seconds``, or a quarter of the series if that is shorter."""
    return F.least(F.lit(int(noise_seconds * rate)), F.floor(n / 4))


def noise_subtract(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    value: str,
    rate: float,
    reduce: float = 1.0,
    n_fft: int = 512,
    hop: int = 160,
    noise_seconds: float = 0.5,
    least_seconds: float = 0.1,
) -> DataFrame:
    """Subtract a share of the noise profile from each spectral frame, never below 0.

    The profile is the mean power per bin of the frames that start in the first ``noise_seconds`` or
    the first quarter of the series, whichever ends first. Series under ``least_seconds`` keep their spectrum.
    """
    in_blocks = isinstance(df.schema[value].dataType, ArrayType)
    size = F.sum(F.size(value)) if in_blocks else F.count(F.lit(1))
    sizes = df.groupBy(*keys).agg(size.alias("n"))
    spectra = pinned(frame_spectrum(df, keys, idx, value, n_fft, hop))
    share = F.when(F.col("n") >= F.lit(rate * least_seconds), F.lit(float(reduce))).otherwise(F.lit(0.0))
    held = scale.attach(spectra, sizes.select(*keys, _noise_end(F.col("n"), rate, noise_seconds).alias("_end"), share.alias("_share")), keys, ["frame"])
    # The first frame always counts, so even a very short profile is defined.
    noisy = held.where((F.col("frame") * hop < F.col("_end")) | (F.col("frame") == 0))
    per_bin = noisy.select(*keys, F.posexplode("spectrum").alias("bin", "p")).groupBy(*keys, "bin").agg(F.avg("p").alias("p"))
    profile = per_bin.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bin", "p"))).alias("_b"))
    profile = profile.select(*keys, F.col("_b.p").alias("_noise"))
    joined = scale.attach(held.drop("_end"), profile, keys, ["frame"])
    left = F.zip_with("spectrum", "_noise", lambda p, q: F.greatest(p - F.col("_share") * q, F.lit(0.0)))
    return joined.select(*keys, "frame", left.alias("spectrum"))


def _frames(x: np.ndarray, first: int, low: int, high: int, n_fft: int, hop: int) -> np.ndarray:
    """Samples of the centred frames ``low`` .. ``high`` (rows) of a series of which ``x`` starts at place ``first``; zero elsewhere."""
    begin = low * hop - n_fft // 2
    padded = np.zeros((high - low) * hop + n_fft)
    a, b = max(begin, first), min(begin + len(padded), first + len(x))
    padded[a - begin : b - begin] = x[a - first : b - first]
    return np.lib.stride_tricks.sliding_window_view(padded, n_fft)[::hop]


def _joined(head: pa.Array, own: pa.Array, tail: pa.Array, k: int) -> tuple[np.ndarray, int, int]:
    """A block with its neighbours' ends, the length of the first end and of the block itself."""
    parts = [np.zeros(0) if c[k].as_py() is None else np.asarray(c[k].values.to_numpy(zero_copy_only=False), dtype=float) for c in (head, own, tail)]
    return np.concatenate(parts), len(parts[0]), len(parts[1])


def noise_profile(blocks_with_ends: DataFrame, keys: Sequence[str], value: str, rate: float, span: int, n_fft: int, hop: int, noise_seconds: float = 0.5) -> DataFrame:
    """keys, noise: mean power per bin of the frames that start in the noise sample, the first frame in any case.

    Only the blocks of the noise sample are transformed; a series has at most ``noise_seconds`` of them.
    """
    window = kernels.hann(n_fft)

    @arrow_udf("array<double>")
    def run(head: pa.Array, own: pa.Array, tail: pa.Array, q: pa.Array, end: pa.Array, n: pa.Array) -> pa.Array:
        made = []
        for k in range(len(own)):
            x, before, size = _joined(head, own, tail, k)
            start = q[k].as_py() * span
            low, high = -(-start // hop), min((start + span - 1) // hop, n[k].as_py() // hop)
            high = min(high, max(-(-end[k].as_py() // hop) - 1, 0))
            if high < low:
                made.append(np.zeros(n_fft // 2 + 2))
                continue
            power = np.abs(np.fft.rfft(_frames(x, start - before, low, high, n_fft, hop) * window, axis=1)) ** 2
            made.append(np.append(power.sum(axis=0), len(power)))
        return pa.array(made, pa.list_(pa.float64()))

    end = _noise_end(F.col("_n"), rate, noise_seconds)
    early = blocks_with_ends.where((F.col("_q") * span < end) | (F.col("_q") == 0))
    sums = early.select(*keys, "_q", run("_head", value, "_tail", "_q", end.cast("long"), "_n").alias("_s"))
    held = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_q", "_s"))).alias("_b"))
    zero = F.array_repeat(F.lit(0.0), n_fft // 2 + 2)
    total = F.aggregate(F.col("_b._s"), zero, lambda a, s: F.zip_with(a, s, lambda x, y: x + y))
    return held.select(*keys, total.alias("_t")).select(*keys, F.transform(F.slice("_t", 1, n_fft // 2 + 1), lambda v: v / F.element_at("_t", -1)).alias("noise"))


def noise_reduced(
    held: DataFrame, keys: Sequence[str], value: str, rate: float, share: float = fixed.NOISE_SHARE, n_fft: int = 512, hop: int = 160,
    noise_seconds: float = 0.5, least_seconds: float = 0.1, profile: DataFrame | None = None, span: int = blocks.SPAN,
) -> DataFrame:
    """Block table of the series with a share of the noise power taken out of every spectral frame, and ``reduced``.

    Each frame's bins are scaled by the root of what the subtraction leaves of their power, turned back, windowed and added where frames
    overlap, over the sum of squared windows. A block computes every frame that reaches into it from its own
    samples and those its neighbours lend it, so frames over a border are summed without another shuffle. ``profile``
    (keys, noise) takes the place of the series' own start. Series under ``least_seconds`` come back unchanged with ``reduced`` false. A block
    whose kernel fails comes back unchanged too, with the reason in ``error``.
    """
    if n_fft > span:
        raise ValueError("frames must not be longer than a block of samples")
    window, half, on = kernels.hann(n_fft), n_fft // 2, list(keys)

    @arrow_udf("struct<x:array<double>,error:string>")
    def run(head: pa.Array, own: pa.Array, tail: pa.Array, q: pa.Array, n: pa.Array, noise: pa.Array) -> pa.Array:
        made, errors = [], []
        for k in range(len(own)):
            x, before, size = _joined(head, own, tail, k)
            plain = x[before : before + size]
            if noise[k].as_py() is None:
                made.append(plain)
                errors.append(None)
                continue
            try:
                start = q[k].as_py() * span
                low = max((start + half - n_fft) // hop + 1, 0)
                high = min(-(-(start + size + half) // hop) - 1, n[k].as_py() // hop)
                spectrum = np.fft.rfft(_frames(x, start - before, low, high, n_fft, hop) * window, axis=1)
                power = np.abs(spectrum) ** 2
                left = np.maximum(power - share * np.asarray(noise[k].values.to_numpy(zero_copy_only=False)), 0)
                gain = np.sqrt(np.divide(left, power, out=np.zeros_like(power), where=power > 0))
                back = np.fft.irfft(spectrum * gain, n_fft, axis=1) * window
                at = start - (low * hop - half)
                # Behind the last frame there may be samples that no window reaches.
                total, weight = np.zeros((2, max((high - low) * hop + n_fft, at + size)))
                for j, frame in enumerate(back):
                    total[j * hop : j * hop + n_fft] += frame
                    weight[j * hop : j * hop + n_fft] += window**2
                total, weight = total[at : at + size], weight[at : at + size]
                # Places that no window weighs keep their value.
                made.append(np.where(weight > 1e-10, total / np.maximum(weight, 1e-10), plain))
                errors.append(None)
            except Exception as e:  # noqa: BLE001 one bad block must not end the run
                made.append(plain)
                errors.append(f"{type(e).__name__}: {e}")
        return pa.StructArray.from_arrays([pa.array(made, pa.list_(pa.float64())), pa.array(errors, pa.string())], names=["x", "error"])

    met = scale.block_neighbours(held.select(*on, "_n", "_q", value), [*on, "_n"], "_q", value, n_fft, n_fft).where(F.col(value).isNotNull())
    if profile is None:
        profile = noise_profile(met.where(F.col("_n") >= F.lit(rate * least_seconds)), on, value, rate, span, n_fft, hop, noise_seconds)
    known = profile.select(*on, F.col("noise").alias("_noise"))
    joined = scale.attach(met, known, on, ["_q"], "left")
    usable = F.when(F.col("_n") >= F.lit(rate * least_seconds), F.col("_noise"))
    out = joined.select(*on, "_q", "_n", usable.isNotNull().alias("reduced"), run("_head", value, "_tail", "_q", "_n", usable).alias("_o"))
    return out.select(*on, "_q", "_n", F.col("_o.x").alias(value), (F.col("reduced") & F.col("_o.error").isNull()).alias("reduced"), F.col("_o.error").alias("error"))


def noise_reduce(
    df: DataFrame, keys: Sequence[str], idx: str, value: str, rate: float, share: float = fixed.NOISE_SHARE, n_fft: int = 512, hop: int = 160,
    noise_seconds: float = 0.5, least_seconds: float = 0.1, profile: DataFrame | None = None,
) -> DataFrame:
    """``noise_reduced`` for a series with one row per sample: keys, idx, value, reduced."""
    out = noise_reduced(blocks.from_rows(df, keys, idx, [value]), keys, value, rate, share, n_fft, hop, noise_seconds, least_seconds, profile)
    rows = out.select(*keys, "_q", "reduced", F.posexplode(value).alias("_p", value))
    return rows.select(*keys, (F.col("_q") * blocks.SPAN + F.col("_p")).cast("long").alias(idx), value, "reduced")
