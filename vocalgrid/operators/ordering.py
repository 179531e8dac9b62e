"""Rank, shard, split and chunk operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocalgrid import scale
from vocalgrid.functions import columns as C


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First n rows of each group. Spark limits each group inside every task before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)
    return ranked.withColumn("rank", F.col("rank").cast("long"))


def best_per_subject(df: DataFrame, subject: str, utt: str, correlation: str) -> DataFrame:
    """Utterance with the highest correlation (missing counts as 0, NaN comes after all numbers), the first one on ties."""
    score = F.coalesce(F.col(correlation), F.lit(0.0))
    return top_n(df, [subject], [*descending(score), F.col(utt).asc()], 1).drop("rank")


def descending(value: Column) -> list[Column]:
    """Order from the highest number down, NaN after all numbers (Spark alone takes NaN for the highest), null last."""
    return [F.isnan(value.cast("double")).asc(), value.desc_nulls_last()]


def rank_best_worst(df: DataFrame, correlation: str, utt: str, k: int = 1) -> DataFrame:
    """First and last k of the descending order, NaN in neither before all numbers are used up; two top-k scans, no full sort."""
    best = df.orderBy(*descending(F.col(correlation)), F.col(utt).asc()).limit(k).withColumn("kind", F.lit("best"))
    worst = df.orderBy(F.col(correlation).asc(), F.col(utt).desc()).limit(k).withColumn("kind", F.lit("worst"))
    return best.unionByName(worst)


def tier_representatives(df: DataFrame, utt: str, correlation: str) -> DataFrame:
    """Best, one from the middle of each tier, the first POOR one, and the worst."""
    c = F.col(correlation)
    band = (
        F.when(F.isnan(c.cast("double")), "POOR").when(c >= 0.3, "GOOD").when(c >= 0.2, "MODERATE").when(c >= 0.1, "ACCEPTABLE").otherwise("POOR")
    )
    narrow = df.select(F.col(utt).alias("utt"), c.alias("correlation"), band.alias("kind"))
    placed = scale.with_position(narrow, ["kind"], [*descending(F.col("correlation")), F.col("utt").asc()], "_pos")
    sizes = scale.group_size(narrow, ["kind"], "_n")
    # Five bands at most, so the wanted place of each band is a five-row table.
    wanted = sizes.where((F.col("kind") != "GOOD") | (F.col("_n") > 1)).select(
        "kind", F.when(F.col("kind") == "POOR", F.lit(0)).otherwise(F.floor(F.col("_n") / 2)).cast("long").alias("_pos")
    )
    middle = placed.join(F.broadcast(wanted), ["kind", "_pos"]).select("kind", "utt", "correlation")
    ends = rank_best_worst(narrow.drop("kind"), "correlation", "utt")
    ends = ends.withColumn("kind", F.upper("kind"))
    return middle.unionByName(ends)


def ecdf(df: DataFrame, value: str, tie: str) -> DataFrame:
    """Each value with its rank share i / n * 100 in ascending order."""
    n = df.count()
    placed = scale.with_position(df.select(tie, value), [], [F.col(value), F.col(tie)], "_pos", largest=n)
    return placed.select(tie, value, ((F.col("_pos") + 1) / F.lit(n) * 100).alias("percent"))


def first_subjects(df: DataFrame, subject: str, m: int) -> DataFrame:
    """Rows of the first m subjects in name order."""
    first = df.select(subject).distinct().orderBy(subject).limit(m)
    return df.join(first, subject, "left_semi")


def shard_assign(df: DataFrame, order: Sequence[str], shards: int) -> DataFrame:
    """Contiguous shards in the given order; the first n mod shards of them hold one row more."""
    n = df.count()
    placed = scale.with_position(df, [], list(order), "position", largest=n).withColumn("_n", F.lit(n))
    base, rest = F.floor(F.col("_n") / shards), F.col("_n") % shards
    edge = rest * (base + 1)
    shard = F.when(F.col("position") < edge, F.floor(F.col("position") / (base + 1))).otherwise(
        rest + F.floor((F.col("position") - edge) / F.greatest(base, F.lit(1)))
    )
    return placed.withColumn("shard", shard.cast("long")).drop("_n")


def shard_manifest(assigned: DataFrame, name: str, shards: int, page: int = 1000) -> DataFrame:
    """Per shard the file count and the sorted names in pages of bounded length; empty shards kept."""
    held = assigned.withColumn("_first", F.col("position") - F.col("position") % page)
    pages = held.groupBy("shard", F.floor(F.col("position") / page).cast("long").alias("page")).agg(
        F.array_sort(F.collect_list(F.struct("position", F.col(name).cast("string").alias("f")))).alias("_f"),
        F.count(F.lit(1)).alias("files_in_page"),
    )
    counts = assigned.groupBy("shard").agg(F.count(F.lit(1)).alias("num_files"))
    every = assigned.sparkSession.range(shards).withColumnRenamed("id", "shard")
    # Counts go to the pages, salted, so that a large shard's pages are not drawn into one task.
    named = pages.select("shard", "page", "files_in_page", F.col("_f.f").alias("files"))
    listed = scale.attach(named, counts, ["shard"], ["page"])
    empty = every.join(counts, "shard", "left_anti").withColumn("num_files", F.lit(0).cast("long"))
    return listed.unionByName(empty, allowMissingColumns=True)


def sequence_chunks(
    df: DataFrame, utt: str, idx: str, length: int, n: str = "_n"
) -> DataFrame:
    """Fixed-length pieces ``{utt}_seq{i}``; frames of an unfinished last piece are dropped."""
    sized = scale.with_group_size(df, [utt], spread_on=[idx], name=n)
    piece = F.floor(F.col(idx) / length)
    return (
        sized.withColumn("chunk", piece.cast("long"))
        .where(F.col("chunk") < F.floor(F.col(n) / length))
        .withColumn("sequence", F.concat(F.col(utt).cast("string"), F.lit("_seq"), F.col("chunk").cast("string")))
        .withColumn("start_idx", F.col("chunk") * length)
        .withColumn("end_idx", (F.col("chunk") + 1) * length)
        .drop(n)
    )


def _cut(df: DataFrame, n: int, first: tuple[str, Column], second: tuple[str, Column], last: str) -> DataFrame:
    """Name the split of each position from the sizes of the first two parts."""
    held = df.withColumn("_n", F.lit(n))
    split = (
        F.when(F.col("_pos") < first[1], first[0])
        .when(F.col("_pos") < first[1] + second[1], second[0])
        .otherwise(last)
    )
    return held.withColumn("split", split).drop("_n", "_pos")


def subject_split(
    df: DataFrame, subject: str, train: float = 0.7, val: float = 0.15, test: float = 0.15, seed: int = 42
) -> DataFrame:
    """Train int(n * train), validation int(n * val), the rest test; one row per subject.

    Subjects are ordered by a hash of the seed and their name, so any rerun gives the same split.
    """
    if abs(train + val + test - 1.0) > 1e-6:
        raise ValueError("ratios must sum to 1")
    subjects = df.select(subject).distinct()
    n = subjects.count()
    placed = scale.with_position(subjects, [], [C.draw_text(seed, F.col(subject)), F.col(subject)], "_pos", largest=n)
    size = lambda ratio: F.floor(F.col("_n") * F.lit(ratio))
    return _cut(placed, n, ("train", size(train)), ("val", size(val)), "test")


def label_dir_split(df: DataFrame, name: str, val: float = 0.15, test: float = 0.15, seed: int = 42) -> DataFrame:
    """Test int(n * test), validation int(n * val), train the rest, in the order train, val, test."""
    names = df.select(name).distinct()
    n = names.count()
    placed = scale.with_position(names, [], [C.draw_text(seed, F.col(name)), F.col(name)], "_pos", largest=n)
    n_val, n_test = F.floor(F.col("_n") * F.lit(val)), F.floor(F.col("_n") * F.lit(test))
    return _cut(placed, n, ("train", F.col("_n") - n_val - n_test), ("val", n_val), "test")


def ordered_split(df: DataFrame, name: str, first: float = 0.8, second: float = 0.9) -> DataFrame:
    """Sorted names cut at int(0.8 n) and int(0.9 n)."""
    names = df.select(name).distinct()
    n = names.count()
    placed = scale.with_position(names, [], [F.col(name)], "_pos", largest=n)
    a, b = F.floor(F.col("_n") * F.lit(first)), F.floor(F.col("_n") * F.lit(second))
    return _cut(placed, n, ("train", a), ("val", b - a), "test")


def split_leaks(splits: DataFrame, key: str) -> DataFrame:
    """Keys that appear in more than one split: none for a clean split."""
    return (
        splits.select(key, "split").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    )


def pad_collate(df: DataFrame, utt: str, idx: str, value: str, batch_size: int) -> DataFrame:
    """Zero-pad every sequence to the longest of its batch; one row per position with its mask.

    Batches are runs of ``batch_size`` sequences in name order. ``is_pad`` is true from the
    sequence's own length on.
    """
    sizes = scale.group_size(df, [utt], "length")
    placed = scale.with_position(sizes, [], [utt], "_pos").withColumn(
        "batch", F.floor(F.col("_pos") / batch_size).cast("long")
    )
    batches = Window.partitionBy("batch")  # at most batch_size rows each
    plan = placed.withColumn("longest", F.max("length").over(batches)).drop("_pos")
    real = scale.attach(df.select(utt, idx, F.col(value).cast("double").alias(value)), plan, [utt], [idx])
    blank = scale.explode_range(plan, F.col("length"), F.col("longest"), idx).withColumn(value, F.lit(0.0))
    rows = real.unionByName(blank.select(real.columns))
    return rows.withColumn("is_pad", F.col(idx) >= F.col("length"))
