"""The batch jobs: compositions of the operators, with failures recorded instead of raised."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from vocalgrid import fixed, scale
from vocalgrid.functions import columns as C
from vocalgrid.operators import audio as spectra
from vocalgrid.operators import blocks, frames, geometry, ordering, pca, selection, series, summaries
from vocalgrid.session import pinned
from vocalgrid.sources import stores


def failure_ledger(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Add error: the name of the first check that holds, null for good rows. One pass."""
    error = F.coalesce(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in checks.items()])
    return df.withColumn("error", error)


def succeeded(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("error").isNull()).drop("error")


def failed(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("error").isNotNull())


def _having(df: DataFrame, utterances: DataFrame, keys: list[str], idx: str) -> DataFrame:
    """Rows of the listed utterances; a long utterance is spread over the partitions."""
    return scale.attach(df, utterances.select(*keys), keys, [idx], "left_semi")


def envelope_blocks(heard: DataFrame, keys: Sequence[str], value: str, smooth_ms: float, rate: float, span: int) -> DataFrame:
    """Block table of the envelope: magnitude of the analytic signal, smoothed and scaled to 0..1 per utterance."""
    smooth = blocks.smoothed(blocks.magnitude(heard, keys, value, span), keys, value, series.smoothing_weights(smooth_ms, rate))
    # Read for the ends and for the values.
    return blocks.minmax(pinned(smooth), keys, value)


def audio_envelope(
    df: DataFrame, keys: Sequence[str], idx: str, value: str, smooth_ms: float, rate: float, out: str = "envelope"
) -> DataFrame:
    """Magnitude of the analytic signal, smoothed and scaled to 0..1 per utterance."""
    span = blocks.span_for(len(series.smoothing_weights(smooth_ms, rate)) // 2)
    heard = blocks.from_rows(df, keys, idx, [value], span)
    return blocks.to_rows(envelope_blocks(heard, keys, value, smooth_ms, rate, span), keys, idx, value, out, span)


def motion_blocks(
    df: DataFrame, keys: Sequence[str], idx: str, pixels: str, smooth_ms: float, fps: float, span: int,
    width: int | None = None, roi: tuple[int, int, int, int] | None = None,
) -> DataFrame:
    """Block table of the summed frame difference (of a region, where given), smoothed and scaled to 0..1 per utterance."""
    raw = frames.motion_energy(df, keys, idx, pixels, "l1", width, roi, out="energy")
    held = blocks.from_rows(raw, keys, idx, ["energy"], span)
    # One number per frame is kept; the pixels are read once.
    smooth = pinned(blocks.smoothed(held, keys, "energy", series.smoothing_weights(smooth_ms, fps)))
    return blocks.minmax(smooth, keys, "energy")


def motion_signal(
    df: DataFrame, keys: Sequence[str], idx: str, pixels: str, smooth_ms: float, fps: float, out: str = "energy",
    width: int | None = None, roi: tuple[int, int, int, int] | None = None,
) -> DataFrame:
    """The same with a row per frame."""
    span = blocks.span_for(len(series.smoothing_weights(smooth_ms, fps)) // 2)
    return blocks.to_rows(motion_blocks(df, keys, idx, pixels, smooth_ms, fps, span, width, roi), keys, idx, "energy", out, span)


def align(
    images: DataFrame,
    audio: DataFrame,
    keys: Sequence[str],
    idx: str,
    pixels: str,
    value: str,
    fps: float,
    rate: float,
    smooth_ms: float,
    width: int | None = None,
    roi: tuple[int, int, int, int] | None = None,
) -> DataFrame:
    """Offset and correlation of each utterance's audio against its image motion, over all lags.

    Motion (of the region ``roi`` of frames of that ``width``, where given) is brought to the audio clock (0
    outside), both are standardised over their own length, padded to the longer one and multiplied at every lag
    from minus half of that length to plus half. A positive offset means the audio is late.
    """
    on = list(keys)
    frame_span, span = (blocks.span_for(len(series.smoothing_weights(smooth_ms, r)) // 2) for r in (fps, rate))
    heard = audio_blocks(audio, on, idx, value, span)
    n_samples = heard.groupBy(*on).agg(F.max("_n").alias("n_samples"))
    both = scale.group_size(images, on, "n_frames").join(n_samples, on)
    seconds = F.greatest(F.col("n_frames") / F.lit(float(fps)), F.col("n_samples") / F.lit(float(rate)))
    n_targets = F.ceil(seconds * F.lit(float(rate))).cast("long")
    # One row per utterance; N is the length both series are padded to.
    plan = pinned(
        both.withColumn("n_targets", n_targets).withColumn("length", F.greatest("n_targets", "n_samples"))
    )
    moved = motion_blocks(_having(images, plan, on, idx), on, idx, pixels, smooth_ms, fps, frame_span, width, roi)
    clocked = pinned(blocks.resampled(moved, on, "energy", fps, rate, plan, frame_span, span))
    m = blocks.zscore(clocked, on, "energy")
    envelope = pinned(envelope_blocks(_having(heard, plan, on, "_q"), on, value, smooth_ms, rate, span))
    a = blocks.zscore(envelope, on, value)
    best = blocks.best_correlation(a, m, on, value, "energy", plan, span).join(plan, on)
    return best.select(
        *on,
        "n_frames",
        "n_samples",
        F.col("lag").alias("offset_samples"),
        (F.col("lag") / F.lit(float(rate))).alias("offset_seconds"),
        "correlation",
    )


def audio_blocks(audio: DataFrame, keys: Sequence[str], idx: str, value: str, span: int = blocks.SPAN) -> DataFrame:
    """Audio as a block table: given as one, as rows of samples, or as rows of arrays with the position of their first sample."""
    if "_q" in audio.columns and "_n" in audio.columns:
        return audio
    if isinstance(audio.schema[value].dataType, ArrayType):
        typed = audio.select(*keys, idx, F.col(value).cast("array<double>").alias(value))
        return blocks.sized(blocks.reblocked(typed, keys, idx, [value], span), keys, value)
    return blocks.from_rows(audio, keys, idx, [value], span)


def frame_times(images: DataFrame, keys: Sequence[str], idx: str, fps: float, out: str = "timestamp") -> DataFrame:
    """Time of each frame in seconds from the utterance's start."""
    return images.select(*keys, idx, (F.col(idx) / F.lit(float(fps))).alias(out))


def aligned_audio(
    audio: DataFrame, aligned: DataFrame, keys: Sequence[str], idx: str, value: str, fps: float, rate: float, compat: bool = False
) -> DataFrame:
    """Audio shifted by the found offset and cut or padded to int(frames / fps * rate) samples."""
    plan = aligned.select(
        *keys,
        F.col("offset_samples").alias("offset"),
        F.floor(F.col("n_frames") / F.lit(float(fps)) * F.lit(float(rate))).cast("long").alias("out_len"),
    )
    return series.shift_series(audio, keys, idx, value, plan, compat=compat)


def _checked(images: DataFrame, audio: DataFrame, on: list[str], pixels: str, value: str, width_of_frame: int, rate: float) -> DataFrame:
    """One row per utterance of the images: counts, and the first reason why no kernel may see it."""
    bad_pixel = F.exists(pixels, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    bad_frame = F.coalesce((F.size(pixels) != width_of_frame) | bad_pixel, F.lit(True))
    infinite = lambda v: F.coalesce(F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")), F.lit(True))
    in_arrays = isinstance(audio.schema[value].dataType, ArrayType)
    bad_sample = F.coalesce(F.exists(value, infinite), F.lit(True)) if in_arrays else infinite(F.col(value))
    samples = F.sum(F.coalesce(F.size(value), F.lit(0))).cast("long") if in_arrays else F.count(F.lit(1))
    shown = images.groupBy(*on).agg(F.count(F.lit(1)).alias("n_frames"), F.max(bad_frame).alias("bad_frames"))
    heard = audio.groupBy(*on).agg(samples.alias("n_samples"), F.max(bad_sample).alias("bad_audio"))
    return failure_ledger(
        shown.join(heard, on, "left"),
        {
            "no audio": F.col("n_samples").isNull(),
            "audio too short": F.col("n_samples") < F.lit(rate * 0.1),
            "frames not usable": F.col("bad_frames"),
            "audio not finite": F.col("bad_audio"),
        },
    )


def _keep(df: DataFrame, name: str, place: str | None) -> DataFrame:
    """The rows, kept so that they can be read more than once: as Parquet below ``place``, or checkpointed."""
    if place is None:
        return pinned(df)
    df.write.mode("overwrite").parquet(f"{place}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{place}/{name}")


def processed(
    images: DataFrame, audio: DataFrame, keys: Sequence[str], idx: str, pixels: str, value: str, height: int, width: int, fps: float, rate: float, smooth_ms: float,
    minimum: float = fixed.BATCH_MIN_CORRELATION, roi: tuple[int, int, int, int] | None = None, noise_share: float | None = None,
    n_fft: int = 512, hop: int = 160, blur: Callable[[np.ndarray], np.ndarray] | None = None, place: str | None = None, channels: int = 1,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Manifest, denoised frames and denoised audio (a block table) of every utterance of the images.

    Images are blurred and put through the temporal median; the audio loses ``noise_share`` of its noise, if one is named; both are
    aligned and the result is judged. Failures are the manifest's, never the run's: utterances without audio, under the least length, or with
    a frame or sample that no kernel may see never reach a kernel, and a kernel that fails on a frame or block takes out that
    utterance alone (``guarded_kernel``). Frames with ``channels`` hold them one after the other. With a ``place``, frames and audio are written there once and read back.
    """
    on = list(keys)
    ledger = pinned(_checked(images, audio, on, pixels, value, height * width * channels, rate))
    good = succeeded(ledger).select(*on)
    kernel = blur or frames.blur_kernel(height, width, 1.0)
    clean = _keep(frames.denoise_guarded(_having(images, good, on, idx), on, idx, pixels, kernel), "frames", place)
    span = blocks.span_for(len(series.smoothing_weights(smooth_ms, rate)) // 2)
    sound = audio_blocks(_having(audio, good, on, idx), on, idx, value, span)
    if noise_share is not None:
        sound = spectra.noise_reduced(sound, on, value, rate, noise_share, n_fft, hop, span=span)
    else:
        sound = sound.select(*on, "_q", "_n", value, F.lit(False).alias("reduced"), F.lit(None).cast("string").alias("error"))
    heard = _keep(sound, "audio", place)
    raised = clean.select(*on, F.lit("frames").alias("_what"), "error").unionByName(heard.select(*on, F.lit("audio").alias("_what"), "error")).where(F.col("error").isNotNull())
    faults = raised.groupBy(*on).agg(F.min(F.concat_ws(": ", "_what", "error")).alias("fault"))
    sane = good.join(faults, on, "left_anti")
    found = align(
        _having(clean.select(*on, idx, pixels), sane, on, idx), _having(heard.select(*on, "_q", "_n", value), sane, on, "_q"), on, idx, pixels, value, fps, rate, smooth_ms, width, roi
    )
    judged = selection.validate_alignment(pinned(found), minimum)
    tiered = judged.withColumn("tier", C.quality_tier(F.col("correlation"))).withColumn("error", F.lit(None).cast("string"))
    missing = failed(ledger).select(*on, "error").unionByName(faults.select(*on, F.col("fault").alias("error")))
    return tiered.unionByName(missing, allowMissingColumns=True), clean, heard


def preprocess(
    images: DataFrame, audio: DataFrame, keys: Sequence[str], idx: str, pixels: str, value: str, height: int, width: int, fps: float, rate: float, smooth_ms: float,
    minimum: float = fixed.BATCH_MIN_CORRELATION, roi: tuple[int, int, int, int] | None = None, noise_share: float | None = None,
    n_fft: int = 512, hop: int = 160, blur: Callable[[np.ndarray], np.ndarray] | None = None, channels: int = 1,
) -> DataFrame:
    """Denoise the images and, with a ``noise_share``, the audio; align them and judge the result: one row per utterance (``processed``)."""
    return processed(images, audio, keys, idx, pixels, value, height, width, fps, rate, smooth_ms, minimum, roi, noise_share, n_fft, hop, blur, channels=channels)[0]


def preprocess_store(
    images: DataFrame, audio: DataFrame, place: str, subject: Column, keys: Sequence[str], idx: str, pixels: str, value: str, height: int, width: int, fps: float, rate: float,
    smooth_ms: float, minimum: float = fixed.BATCH_MIN_CORRELATION, roi: tuple[int, int, int, int] | None = None, noise_share: float = fixed.NOISE_SHARE,
    n_fft: int = 512, hop: int = 160, blur: Callable[[np.ndarray], np.ndarray] | None = None, parts: int = 1, channels: int = 1,
) -> DataFrame:
    """The batch job as one that can be started again: stores frames, aligned audio and a manifest below ``place``, returns the manifest.

    Utterances are done in ``parts`` by the hash of their key. A part writes its frames and audio below a name of its own and then
    its manifest rows, which commit its utterances: readers see only what the manifest names. A run leaves out every utterance that the
    manifest lists without an error, so one that was cut off goes on where it stopped, and failed utterances are tried again.
    ``subject`` is computed from the keys.
    """
    on, spark = list(keys), images.sparkSession
    before = stores.read_manifest(spark, place, on)
    attempt = 1 if before is None else (before.agg(F.max("attempt")).first()[0] or 0) + 1
    for part in range(parts):
        mine = lambda df: df.where(F.pmod(F.xxhash64(*on), F.lit(parts)) == part)
        todo = mine(images.select(*on).distinct())
        done = stores.read_manifest(spark, place, on)
        if done is not None:
            todo = todo.join(done.where(F.col("error").isNull()).select(*on), on, "left_anti")
        todo = pinned(todo)
        if todo.isEmpty():
            continue
        name = f"part-{uuid.uuid4().hex}"
        manifest, _, heard = processed(
            _having(images, todo, on, idx), _having(audio, todo, on, idx), on, idx, pixels, value, height, width, fps, rate, smooth_ms, minimum, roi,
            noise_share, n_fft, hop, blur, f"{place}/{name}", channels,
        )
        manifest = pinned(manifest)
        plan = manifest.where(F.col("error").isNull()).select(
            *on, F.col("offset_samples").alias("offset"), F.floor(F.col("n_frames") / F.lit(float(fps)) * F.lit(float(rate))).cast("long").alias("out_len")
        )
        span = blocks.span_for(len(series.smoothing_weights(smooth_ms, rate)) // 2)
        lined_up = blocks.shifted(heard, on, value, plan, span)
        lined_up.select(*on, (F.col("_q") * span).alias("start"), value).write.mode("overwrite").parquet(f"{place}/{name}/aligned_audio")
        rows = manifest.select("*", subject.alias("subject"), F.lit(float(fps)).alias("fps"), F.lit(float(rate)).alias("rate"), F.lit(name).alias("part"), F.lit(attempt).alias("attempt"))
        stores.append_manifest(rows, place)
    return stores.read_manifest(spark, place, on)


def stored(manifest: DataFrame, place: str, what: str, keys: Sequence[str], idx: str = "frame_idx") -> DataFrame:
    """The ``frames`` or the ``aligned_audio`` that the manifest commits; rows of parts that were cut off are not seen."""
    spark = manifest.sparkSession
    whole = manifest.where(F.col("error").isNull()).select(*keys, "part")
    # Folders of parts, as many as runs were made.
    names = [r["part"] for r in whole.select("part").distinct().collect()]
    rows = spark.read.option("basePath", place).parquet(*[f"{place}/{n}/{what}" for n in names])
    named = rows.withColumn("part", F.regexp_extract(F.col("_metadata.file_path"), r"(part-[0-9a-f]{32})/", 1))
    return scale.attach(named, whole, [*keys, "part"], ["start" if what == "aligned_audio" else idx], "left_semi").drop("part", "error")


def batch_summary(manifest: DataFrame) -> DataFrame:
    """Utterances, processed, failed and the success rate per subject and, with a null subject, of the whole corpus."""
    return summaries.batch_rollup(manifest.withColumn("ok", F.col("error").isNull()), "subject", F.col("ok"))


def parameters(
    masks: DataFrame, keys: Sequence[str], mask: str, height: int, width: int, kind: str = "geometric", k: int = 10
) -> DataFrame:
    """Geometric parameters, PCA scores, or both, per frame."""
    if kind not in ("geometric", "pca", "both"):
        raise ValueError(f"unknown kind {kind}")
    if kind == "geometric":
        return geometry.geometric_features(masks, keys, mask, height, width)
    model = pca.fit(masks, mask, height, width, k)
    scored = masks.select(*keys, pca.transform(model, F.col(mask)).alias("pca"))
    if kind == "pca":
        return scored
    return geometry.geometric_features(masks, keys, mask, height, width).join(scored, list(keys))


def training_table(
    features: DataFrame,
    params: DataFrame,
    splits: DataFrame,
    param_names: Sequence[str],
    utt: str = "utt",
    idx: str = "frame_idx",
    length: int | None = None,
    stats_from: str = "train",
) -> DataFrame:
    """Feature frames joined with standardised parameters, split, and cut into sequences.

    ``stats_from='train'`` standardises every split with the training statistics; ``'split'`` gives
    each split its own. ``splits`` holds (utt, split).
    """
    return training_tables(features, params, splits, param_names, utt, idx, length, stats_from)[0]


def training_tables(
    features: DataFrame,
    params: DataFrame,
    splits: DataFrame,
    param_names: Sequence[str],
    utt: str = "utt",
    idx: str = "frame_idx",
    length: int | None = None,
    stats_from: str = "train",
) -> tuple[DataFrame, DataFrame]:
    """The training table, and one row with an ``error`` for every utterance of either side that is not in it."""
    joined, counts = selection.feature_param_report(features, params, utt, idx)
    named = counts.join(splits.select(utt, "split"), utt, "left")
    faults = named.withColumn("error", F.coalesce("error", F.when(F.col("split").isNull(), "no split"))).where(F.col("error").isNotNull()).drop("split")
    # Statistics, scaling and sequence counts each read the joined table: it is joined once.
    held = pinned(scale.attach(joined, splits.select(utt, "split"), [utt], [idx]))
    if stats_from == "train":
        stats = summaries.norm_stats(held.where(F.col("split") == "train"), param_names)
        scaled = summaries.standardize(held, stats, param_names)
    else:
        per_split = held.groupBy("split").agg(
            *[F.avg(p).alias(f"mean_{p}") for p in param_names],
            *[F.greatest(F.stddev_pop(p), F.lit(0.0)).alias(f"std_{p}") for p in param_names],
        )
        scaled = held.join(F.broadcast(per_split), "split")  # one row per split name
        for p in param_names:
            std = F.when(F.col(f"std_{p}") < fixed.SCALE_EPSILON, 1.0).otherwise(F.col(f"std_{p}"))
            scaled = scaled.withColumn(f"{p}_z", (F.col(p) - F.col(f"mean_{p}")) / std)
        scaled = scaled.drop(*[f"{s}_{p}" for p in param_names for s in ("mean", "std")])
    return (scaled if length is None else ordering.sequence_chunks(scaled, utt, idx, length)), faults
