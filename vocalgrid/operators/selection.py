"""Filters, key joins and set operations on subject, utterance and frame tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalgrid import fixed, scale
from vocalgrid.functions import columns as C
from vocalgrid.session import pinned


def select_subjects(
    subjects: DataFrame, mode: str, key: str = "subject", ids: Sequence | None = None, quality: DataFrame | None = None
) -> DataFrame:
    """``all`` subjects, the ``explicit`` ids, or the ``recommended`` ones.

    Recommended: listed in ``quality`` with video_snr and audio_snr of at least 4 and a quality score.
    """
    if mode == "all":
        return subjects
    if mode == "explicit":
        return subjects.where(F.col(key).isin(list(ids or [])))
    if mode == "recommended":
        good = quality.where(
            (F.col("video_snr") >= fixed.MIN_VIDEO_SNR)
            & (F.col("audio_snr") >= fixed.MIN_AUDIO_SNR)
            & F.col("quality_score").isNotNull()
        )
        return subjects.join(good.select(key).distinct(), key, "left_semi")
    raise ValueError(f"unknown mode {mode}")


def validate_alignment(df: DataFrame, minimum: float = fixed.MIN_CORRELATION) -> DataFrame:
    """Add is_valid and message from correlation, offset_seconds and n_frames."""
    c = (F.col("correlation"), F.col("offset_seconds"), F.col("n_frames"))
    return df.withColumn("is_valid", C.alignment_is_valid(*c, minimum)).withColumn(
        "message", C.alignment_message(*c, minimum)
    )


def frame_slice(df: DataFrame, idx: str, start: int = 0, end: int | None = None) -> DataFrame:
    """Frames start..end-1 of every utterance, to the last one when ``end`` is None."""
    kept = df.where(F.col(idx) >= start)
    return kept if end is None else kept.where(F.col(idx) < end)


def finite_check(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Does an utterance hold any NaN or any infinity."""
    v = F.col(value).cast("double")
    return df.groupBy(*keys).agg(
        F.coalesce(F.bool_or(F.isnan(v)), F.lit(False)).alias("has_nan"),
        F.coalesce(F.bool_or(C.is_infinite(v)), F.lit(False)).alias("has_inf"),
    )


def notna_series(df: DataFrame, epoch: str, metrics: Sequence[str]) -> DataFrame:
    """Rows with an epoch, unpivoted to (epoch, metric, value) without the nulls."""
    kept = df.dropna(subset=[epoch])
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").cast("double").alias("value")) for m in metrics])
    return (
        kept.select(F.col(epoch).alias("epoch"), F.explode(cells).alias("c"))
        .select("epoch", "c.metric", "c.value")
        .where(F.col("value").isNotNull())
    )


def pair_utterances(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Utterances present on both sides."""
    return left.join(right, key, "inner")


def unpaired_utterances(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Utterances of the left side that have no partner: those a job warns about and skips."""
    return left.join(right.select(key), key, "left_anti")


def frame_count_mismatch(features: DataFrame, params: DataFrame, utt: str = "utt") -> DataFrame:
    """Utterances on both sides whose frame counts differ."""
    a = scale.group_size(features, [utt], "n_features")
    b = scale.group_size(params, [utt], "n_params")
    return a.join(b, utt).where("n_features <> n_params")


def feature_param_report(features: DataFrame, params: DataFrame, utt: str = "utt", idx: str = "frame_idx") -> tuple[DataFrame, DataFrame]:
    """Joined frames of the utterances whose frame counts agree, and every utterance's counts with an ``error`` for the others.

    Each side is read once, in one full outer join whose key includes the frame, so a long utterance spreads over the
    partitions; the verdict of each utterance is counted from its rows and comes back by a salted lookup.
    """
    a = features.withColumn("_f", F.lit(True))
    b = params.withColumn("_p", F.lit(True))
    both = pinned(a.join(b, [utt, idx], "full"))
    n, m = F.count("_f"), F.count("_p")
    differ = F.format_string("frame counts differ: %d features, %d parameters", "n_features", "n_params")
    counts = both.groupBy(utt).agg(n.alias("n_features"), m.alias("n_params")).withColumn("error", (
        F.when(F.col("n_features") == 0, "no features").when(F.col("n_params") == 0, "no parameters").when(F.col("n_features") != F.col("n_params"), differ)
    ))
    good = counts.where(F.col("error").isNull()).select(utt)
    kept = scale.attach(both.where("_f and _p").drop("_f", "_p"), good, [utt], [idx], "left_semi")
    return kept, counts


def feature_param_join(features: DataFrame, params: DataFrame, utt: str = "utt", idx: str = "frame_idx") -> DataFrame:
    """Frames of both sides by (utterance, frame), for utterances whose frame counts agree.

    The others are reported by ``feature_param_report``, whose rows these are.
    """
    return feature_param_report(features, params, utt, idx)[0]


def split_membership(df: DataFrame, splits: DataFrame, split: str, key: str, spread_on: Sequence[str]) -> DataFrame:
    """Rows whose key is named in one split; the rows of a large key are spread by ``spread_on``."""
    return scale.attach(df, splits.where(F.col("split") == split).select(key), [key], spread_on, "left_semi")


def label_frame_join(labels: DataFrame, frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Labels matched with their frames on utterance and frame."""
    return labels.join(frames, list(keys), "inner")


def expected_vs_done(expected: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Expected and processed counts per subject, 0 where nothing was processed."""
    return expected.join(done, key, "left").withColumn("n_done", F.coalesce("n_done", F.lit(0)).cast("long"))


def remaining(expected: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return expected.select(key).join(done.select(key), key, "left_anti")


def pattern_union(listing: DataFrame, path: str, patterns: Sequence[str]) -> DataFrame:
    """Listings of several patterns put together, sorted; a path may match more than once."""
    parts = [listing.where(F.col(path).rlike(p)).withColumn("pattern", F.lit(p)) for p in patterns]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.orderBy(path, "pattern")


def distinct_utterances(listing: DataFrame, path: str) -> DataFrame:
    """The utterances that the files of a listing belong to."""
    named = listing.select(C.utterance_name(F.col(path)).alias("utterance"))
    return named.where(F.col("utterance").isNotNull()).distinct()
