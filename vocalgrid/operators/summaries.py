"""Corpus, subject and utterance level aggregations. All of them combine before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocalgrid import scale

from vocalgrid import fixed, scale
from vocalgrid.functions import columns as C
from vocalgrid.session import pinned


def corpus_stats(df: DataFrame, subject: str, kind: str, has_metadata: Column) -> DataFrame:
    """Per format and in total: subjects, rows and rows with metadata."""
    # Folding to one row per (format, subject) first makes the distinct count cheap.
    folded = df.groupBy(kind, subject).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(has_metadata).alias("m")
    )
    return folded.rollup(kind).agg(
        F.countDistinct(subject).alias("n_subjects"),
        F.sum("n").alias("n_rows"),
        F.sum("m").alias("n_with_metadata"),
    )


def utterances_per_subject(df: DataFrame, subject: str) -> DataFrame:
    counts = df.groupBy(subject).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.sum("n").alias("total"),
        F.count(F.lit(1)).alias("n_subjects"),
        F.avg("n").alias("mean"),
        F.stddev_pop("n").alias("std"),
        F.min("n").alias("least"),
        F.max("n").alias("most"),
    )


def fps_distribution(df: DataFrame, fps: str) -> DataFrame:
    """min, max, mean and median of the known rates."""
    known = df.where(F.col(fps).isNotNull())
    median = scale.exact_quantiles(known, [], fps, [0.5]).select(F.col("quantiles")[0].alias("m"))
    return known.agg(
        F.count(F.lit(1)).alias("n_known"),
        F.min(fps).alias("least"),
        F.max(fps).alias("most"),
        F.avg(fps).alias("mean"),
    ).withColumn("median", median.scalar())


def batch_rollup(df: DataFrame, subject: str, ok: Column) -> DataFrame:
    """Processed and failed utterances per subject and for the corpus, with the success rate."""
    return (
        df.rollup(subject)
        .agg(
            F.grouping_id().cast("long").alias("level"),
            F.count(F.lit(1)).alias("total"),
            F.count_if(ok).alias("processed"),
            F.count_if(~ok).alias("failed"),
        )
        .withColumn("success_rate", F.col("processed") / F.col("total"))
    )


def correlation_distribution(df: DataFrame, value: str, good: float = 0.3) -> DataFrame:
    """Moments (both std flavours), quantiles, and count and share of values >= ``good``."""
    quantiles = scale.exact_quantiles(df, [], value, [0.1, 0.25, 0.5, 0.75, 0.9]).select("quantiles")
    v = F.col(value)
    summary = df.agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        F.stddev_samp(v).alias("std_sample"),
        F.min(v).alias("least"),
        F.max(v).alias("most"),
        F.count_if(v >= good).alias("n_good"),
    ).withColumn("_q", quantiles.scalar())
    names = ["p10", "p25", "median", "p75", "p90"]
    return summary.select(
        "*", *[F.col("_q")[i].alias(q) for i, q in enumerate(names)], (F.col("n_good") / F.col("n")).alias("share_good")
    ).drop("_q")


def tier_counts(df: DataFrame, correlation: str) -> DataFrame:
    return df.groupBy(C.quality_tier(F.col(correlation)).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Equal-width bins between the least and the greatest value, the last one closed, zeros kept."""
    v = F.col(value).cast("double")
    ends = df.agg(F.struct(F.min(v).alias("lo"), F.max(v).alias("hi")).alias("e")).scalar()
    ranged = df.where(v.isNotNull()).select(v.alias("_v"), ends.alias("_e"))
    share = (F.col("_v") - F.col("_e.lo")) / (F.col("_e.hi") - F.col("_e.lo"))
    place = F.when(F.col("_e.hi") == F.col("_e.lo"), F.lit(0)).otherwise(
        F.least(F.floor(share * bins), F.lit(bins - 1))
    )
    counts = ranged.groupBy(place.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    every = df.sparkSession.range(bins).withColumnRenamed("id", "bin").withColumn("_e", ends)
    width = (F.col("_e.hi") - F.col("_e.lo")) / bins
    return every.join(counts, "bin", "left").select(
        "bin",
        (F.col("_e.lo") + F.col("bin") * width).alias("low_edge"),
        F.coalesce("c", F.lit(0)).cast("long").alias("n"),
    )


def signal_stats(df: DataFrame, keys: Sequence[str], value: str, rate: float, bytes_per_value: int = 4) -> DataFrame:
    v = F.col(value)
    return df.groupBy(*keys).agg(
        F.count(v).alias("n"),
        (F.count(v) / F.lit(float(rate))).alias("duration"),
        F.min(v).alias("least"),
        F.max(v).alias("most"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        F.sqrt(F.avg(v * v)).alias("rms"),
        (F.count(v) * bytes_per_value).alias("n_bytes"),
    )


def distinct_values(df: DataFrame, column: str, order: Column) -> DataFrame:
    """Distinct values with their count and the place of their first occurrence."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_at"))


def typical_sample(df: DataFrame, keys: Sequence[str], column: str, order: Column, rate: float) -> DataFrame:
    """First value seen, and mean frame count and duration per utterance."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min_by(column, order).alias("v"), F.min(order).alias("o"))
    return sizes.agg(
        F.min_by("v", "o").alias("typical"),
        F.avg("n").alias("mean_frames"),
        (F.avg("n") / F.lit(float(rate))).alias("mean_duration"),
        F.count(F.lit(1)).alias("n_samples"),
    )


def extraction_stats(df: DataFrame, utt: str, width: Column) -> DataFrame:
    """Per utterance and in total: utterances, frames and parameters per frame."""
    per = df.groupBy(utt).agg(F.count(F.lit(1)).alias("n_frames"), F.max(width).cast("long").alias("n_params"))
    return per.rollup(utt).agg(
        F.count(F.lit(1)).alias("n_utterances"), F.sum("n_frames").alias("n_frames"), F.max("n_params").alias("n_params")
    )


def demographics(df: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Counts for the values of each attribute on its own."""
    sets = [[a] for a in attributes]
    name = F.lit(None).cast("string")
    for a in attributes:
        name = F.when(F.grouping(a) == 0, a).otherwise(name)
    value = F.coalesce(*[F.col(a).cast("string") for a in attributes])
    grouped = df.groupingSets(sets, *attributes).agg(name.alias("attribute"), F.count(F.lit(1)).alias("n"))
    return grouped.select("attribute", value.alias("value"), "n")


def progress(df: DataFrame, done: Column, expected: Column, by: Sequence[str] = ()) -> DataFrame:
    """Done, expected, percent and the minutes left at the assumed seconds per utterance."""
    totals = df.groupBy(*by).agg(F.sum(expected).cast("long").alias("expected"), F.sum(done).cast("long").alias("done"))
    return with_eta(totals)


def with_eta(totals: DataFrame) -> DataFrame:
    left = F.col("expected") - F.col("done")
    return totals.withColumn(
        "percent", F.when(F.col("expected") > 0, F.col("done") / F.col("expected") * 100).otherwise(0.0)
    ).withColumn("eta_minutes", left * F.lit(fixed.SECONDS_PER_UTTERANCE) / 60)


def norm_stats(df: DataFrame, params: Sequence[str]) -> DataFrame:
    """mean_<p> and std_<p> (population; 1 where below 1e-8), one row."""
    means = [F.avg(p).alias(f"mean_{p}") for p in params]
    stds = [
        F.when(F.stddev_pop(p) < fixed.SCALE_EPSILON, F.lit(1.0)).otherwise(F.stddev_pop(p)).alias(f"std_{p}")
        for p in params
    ]
    return df.agg(*means, *stds)


def norm_stats_sampled(df: DataFrame, utt: str, params: Sequence[str], sequences: int = 100) -> DataFrame:
    """The same from the first sequences in name order (at most ``sequences``)."""
    first = df.select(utt).distinct().orderBy(utt).limit(sequences)
    return norm_stats(df.join(first, utt, "left_semi"), params)


def standardize(df: DataFrame, stats: DataFrame, params: Sequence[str], suffix: str = "_z") -> DataFrame:
    """(p - mean) / std with the one-row statistics read once as a scalar subquery."""
    held = df.withColumn("_s", stats.select(F.struct("*")).scalar())
    for p in params:
        held = held.withColumn(f"{p}{suffix}", (F.col(p) - F.col(f"_s.mean_{p}")) / F.col(f"_s.std_{p}"))
    return held.drop("_s")


def denormalize(df: DataFrame, stats: DataFrame, params: Sequence[str], suffix: str = "_z", out: str = "_back") -> DataFrame:
    held = df.withColumn("_s", stats.select(F.struct("*")).scalar())
    for p in params:
        held = held.withColumn(f"{p}{out}", F.col(f"{p}{suffix}") * F.col(f"_s.std_{p}") + F.col(f"_s.mean_{p}"))
    return held.drop("_s")


def masked_mean(df: DataFrame, keys: Sequence[str], value: Column, masked: Column) -> DataFrame:
    """Mean over rows that are not masked; 0 where every row is."""
    kept = F.sum(F.when(masked, 0.0).otherwise(value.cast("double")))
    return df.groupBy(*keys).agg(
        (kept / F.greatest(F.count_if(~masked).cast("double"), F.lit(fixed.MEAN_EPSILON))).alias("masked_mean")
    )


def masked_mse(df: DataFrame, utt: str, predicted: Column, target: Column, masked: Column) -> DataFrame:
    """Squared error of unmasked rows over the padded size: utterances x longest utterance."""
    error = F.when(masked, 0.0).otherwise((predicted - target) * (predicted - target))
    per = df.groupBy(utt).agg(F.sum(error).alias("e"), F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.count(F.lit(1)).alias("n_sequences"),
        F.max("n").alias("longest"),
        (F.sum("e") / (F.count(F.lit(1)) * F.max("n"))).alias("masked_mse"),
    )


def regression_metrics(df: DataFrame, pairs: dict[str, tuple[Column, Column]], valid: Column) -> DataFrame:
    """RMSE and MAE pooled over valid frames and parameters; mean Pearson over defined parameters."""
    kept = df.where(valid)
    parts, errors = [], []
    for i, (p, t) in enumerate(pairs.values()):
        parts += [F.avg((p - t) * (p - t)).alias(f"_sq{i}"), F.avg(F.abs(p - t)).alias(f"_ab{i}")]
        # Pearson from its parts: undefined, not an error, where either side is constant.
        spread = F.stddev_pop(p) * F.stddev_pop(t)
        parts += [F.when(spread > 0, F.covar_pop(p, t) / spread).alias(f"_r{i}")]
        errors.append(i)
    wide = kept.agg(F.count(F.lit(1)).alias("n_frames"), *parts)
    k = F.lit(float(len(errors)))
    squared = sum((F.col(f"_sq{i}") for i in errors[1:]), F.col("_sq0"))
    absolute = sum((F.col(f"_ab{i}") for i in errors[1:]), F.col("_ab0"))
    found = F.filter(F.array(*[F.col(f"_r{i}") for i in errors]), lambda r: r.isNotNull() & ~F.isnan(r))
    pearson = F.when(F.size(found) > 0, C.array_sum(found) / F.size(found)).otherwise(F.lit(0.0))
    return wide.select(
        "n_frames",
        F.sqrt(squared / k).alias("rmse"),
        (absolute / k).alias("mae"),
        pearson.alias("pearson"),
    )


def split_info(assigned: DataFrame, subject: str, utt: str, ratios: dict[str, float], page: int = 1000) -> DataFrame:
    """Per split: subjects, utterances, corpus totals, actual against asked share, and the sorted names in pages of bounded length.

    A page holds ``page`` subjects and as many utterances of its split; the shorter list ends first. Splits that are
    asked for but stay empty have one page without names. A corpus without subjects has no rows.
    """
    per_subject = assigned.groupBy("split", subject).agg(F.count(utt).alias("n"))
    per_split = per_subject.groupBy("split").agg(
        F.count(F.lit(1)).alias("s"), F.sum("n").cast("long").alias("u"),
        F.min(subject).alias("first_subject"), F.max(subject).alias("last_subject"),
    )
    totals = per_split.agg(F.struct(F.sum("s").alias("s"), F.sum("u").alias("u")).alias("t")).scalar()
    asked = assigned.sparkSession.createDataFrame([(k, float(v)) for k, v in ratios.items()], "split string, asked_ratio double")
    held = per_split.join(asked, "split", "full").withColumn("_t", totals).where("_t.s > 0")
    # One row per split, read by all that follows.
    info = pinned(held.select(
        "split", F.coalesce("s", F.lit(0)).cast("long").alias("num_subjects"), F.coalesce("u", F.lit(0)).cast("long").alias("num_utterances"),
        "first_subject", "last_subject", F.col("_t.s").alias("total_subjects"), F.col("_t.u").alias("total_utterances"),
        "asked_ratio", (F.coalesce("s", F.lit(0)) / F.col("_t.s")).alias("actual_ratio"),
    ))
    most = info.agg(F.max("num_subjects").alias("s"), F.max("num_utterances").alias("u")).first()

    def placed(df: DataFrame, name: str, held_as: str, largest: int | None) -> DataFrame:
        names = df.where(F.col(name).isNotNull()).select("split", F.col(name).alias(held_as))
        rows = scale.with_position(names, ["split"], [held_as], "_pos", largest=largest or 0)
        return rows.select("split", F.floor(F.col("_pos") / page).cast("long").alias("page"), held_as)

    listed = placed(per_subject, subject, "_s", most["s"]).unionByName(placed(assigned, utt, "_u", most["u"]), allowMissingColumns=True)
    every = info.select("split", F.lit(0).cast("long").alias("page"))
    pages = listed.unionByName(every, allowMissingColumns=True).groupBy("split", "page").agg(
        F.array_sort(F.collect_list("_s")).alias("subjects"), F.array_sort(F.collect_list("_u")).alias("utterances")
    )
    of_split = F.broadcast(info.withColumnRenamed("split", "_split"))
    return pages.join(of_split, F.col("split").eqNullSafe(F.col("_split"))).select(
        *info.columns, "page", "subjects", "utterances"
    )


def split_members(assigned: DataFrame, subject: str, page: int = 1000) -> DataFrame:
    """The sorted subjects of each split, in pages of bounded length."""
    distinct = assigned.select("split", subject).distinct()
    placed = scale.with_position(distinct, ["split"], [subject], "_pos").withColumn("page", F.floor(F.col("_pos") / page).cast("long"))
    held = placed.groupBy("split", "page").agg(F.array_sort(F.collect_list(subject)).alias("subjects"))
    return held.select("split", "page", "subjects")
