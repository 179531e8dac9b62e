"""The paths for huge groups give what the plain paths give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.brute import analytic_magnitude
from vocalgrid import scale
from vocalgrid.operators import frames, hilbert, ordering, series, spread_fft, summaries


@pytest.fixture(scope="module")
def skewed(spark):
    """Key 0 holds most rows."""
    rng = np.random.default_rng(0)
    rows = [(0 if i % 5 else i % 7, int(i), float(v)) for i, v in enumerate(rng.normal(size=4000).round(3))]
    return spark.createDataFrame(rows, "utt long, id long, value double").repartition(6).cache()


def series_df(spark, lengths, seed=1):
    rng = np.random.default_rng(seed)
    data = {u: rng.normal(size=n) for u, n in lengths.items()}
    rows = [(u, i, float(v)) for u, xs in data.items() for i, v in enumerate(xs)]
    return data, spark.createDataFrame(rows, "utt long, i long, v double").repartition(5)


def by_utt(df, idx, value):
    out = {}
    for r in df.orderBy("utt", idx).collect():
        out.setdefault(r["utt"], []).append(r[value])
    return {u: np.array(v) for u, v in out.items()}


@pytest.mark.parametrize("keys", [["utt"], []])
def test_position_by_range_equals_window(skewed, keys):
    order = [F.col("value").desc(), F.col("id")]
    plain = scale.with_position(skewed, keys, order, "p", group_limit=10**9)
    ranged = scale.with_position(skewed, keys, order, "p", group_limit=0)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, ranged.collect()))


def test_position_by_range_keeps_null_keys(skewed):
    rows = skewed.withColumn("utt", F.when(F.col("utt") > 0, F.col("utt")))
    plain = scale.with_position(rows, ["utt"], ["id"], "p", group_limit=10**9)
    ranged = scale.with_position(rows, ["utt"], ["id"], "p", group_limit=0)
    assert plain.exceptAll(ranged).isEmpty() and ranged.count() == 4000


def test_shards_of_texts_are_not_sorted_in_one_task(spark):
    """Rows with a text are placed by ranges long before two million of them."""
    n, shards = 21_003, 7
    docs = spark.range(n, 0, -1, 4).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assigned = ordering.shard_assign(docs, ["doc_id"], shards)
        assert assigned.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    base, rest = divmod(n, shards)
    shard_of = [k for k in range(shards) for _ in range(base + (k < rest))]
    rows = assigned.orderBy("doc_id").collect()
    assert [(r["doc_id"], r["text"], r["position"], r["shard"]) for r in rows] == [(i + 1, f"text {i + 1}", i, shard_of[i]) for i in range(n)]


@pytest.mark.parametrize("keys", [["utt"], []])
def test_quantiles_by_position_equal_numpy(skewed, keys):
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    rows = skewed.collect()
    for limit in (0, 10**9):
        for r in scale.exact_quantiles(skewed, keys, "value", probs, group_limit=limit).collect():
            xs = [x["value"] for x in rows if not keys or x["utt"] == r["utt"]]
            assert np.allclose(r["quantiles"], np.quantile(xs, probs))


def test_hot_key_is_spread_by_attach(skewed):
    sizes = scale.group_size(skewed, ["utt"])
    skewed.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = scale.attach(skewed, sizes, ["utt"], ["id"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "_salt" in plan and "SortMergeJoin" in plan
        assert joined.count() == skewed.count()
    finally:
        skewed.sparkSession.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_attach_broadcasts_by_the_size_of_all_copies(spark):
    """400,000 groups stay under Spark's threshold, their 16 copies do not."""
    rows = spark.range(2_000_000).withColumn("key", F.col("id") % 1000)
    for groups, joined_by in ((400_000, "SortMergeJoin"), (1_000, "BroadcastHashJoin")):
        per_group = spark.range(groups).select(F.col("id").alias("key"), (F.col("id") * 3).alias("n"))
        joined = scale.attach(rows, per_group, ["key"], ["id"])
        assert joined_by in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.where("n = 3 * key").count() == 2_000_000


def test_explode_range_is_whole(spark):
    df = spark.createDataFrame([(0, 5), (3, 3), (10, 10_000), (7, 2)], "a long, z long")
    got = scale.explode_range(df, F.col("a"), F.col("z"), "i", block=64)
    assert got.count() == 5 + 9990
    assert got.where("a = 10").agg(F.countDistinct("i")).first()[0] == 9990


@pytest.mark.parametrize("block", [4, 7, 1024])
def test_smoothing_over_blocks(spark, block):
    lengths = {1: 50, 2: 3, 3: 1, 4: 14}
    data, df = series_df(spark, lengths)
    weights = series.gaussian_weights(2.0)
    radius = len(weights) // 2
    got = by_utt(series.weighted_neighbours(df, ["utt"], "i", "v", weights, "s", block=block), "i", "s")
    for u, xs in data.items():
        place = np.arange(-radius, len(xs) + radius) % (2 * len(xs))
        padded = xs[np.where(place < len(xs), place, 2 * len(xs) - 1 - place)]
        assert np.allclose(got[u], np.convolve(padded, weights, "valid"))


def test_lag_products_over_tiles(spark):
    data, df = series_df(spark, {1: 40, 2: 6, 3: 5000, 4: 1})
    both = df.withColumn("b", F.col("v") * F.col("v"))
    rows = series.lag_products(both, ["utt"], "i", "v", "b").orderBy("utt", "lag").collect()
    for u, a in data.items():
        got = [(r["lag"], r["total"]) for r in rows if r["utt"] == u]
        assert [g[0] for g in got] == list(range(1 - len(a), len(a)))
        assert np.allclose([g[1] for g in got], np.correlate(a, a * a, "full"))
    near = series.lag_products(both, ["utt"], "i", "v", "b", 8).groupBy("utt").count().collect()
    assert {r["utt"]: r["count"] for r in near} == {1: 17, 2: 11, 3: 17, 4: 1}


def test_best_correlation_takes_the_smallest_tied_lag(spark):
    spikes = [float(i in (100, 300)) for i in range(400)]
    df = spark.createDataFrame([("u", i, v, float(i == 200)) for i, v in enumerate(spikes)], "utt string, i long, a double, b double")
    counted = spread_fft.sized(df, ["utt"], "i")
    sides = [spread_fft.blocks(counted, ["utt"], "i", v, "_n", k) for k, v in enumerate("ab")]
    assert spread_fft.best_correlation(*sides, ["utt"]).collect() == [("u", -100, 1 / 400)]
    assert spread_fft.best_correlation(*[s.where("false") for s in sides], ["utt"]).count() == 0


def test_next_and_previous_over_blocks(spark):
    data, df = series_df(spark, {1: 23})
    got = series.with_previous(series.with_next(df, ["utt"], "i", {"v": "n"}, block=5), ["utt"], "i", {"v": "p"}, block=4)
    rows = got.orderBy("i").collect()
    assert [r["n"] for r in rows] == [*data[1][1:], None]
    assert [r["p"] for r in rows] == [None, *data[1][:-1]]


def test_interpolation_equals_numpy(spark):
    data, df = series_df(spark, {1: 30, 2: 2, 3: 1})
    timed = df.withColumn("t", F.col("i") * 0.37 + 0.1)
    targets = spark.createDataFrame([(1, 60), (2, 9), (3, 4)], "utt long, n_targets long")
    for mode in ("clamp", "zero"):
        got = by_utt(series.interpolate(timed, ["utt"], "i", "t", ["v"], targets, 4.5, mode), "target_idx", "v")
        for u, n in ((1, 60), (2, 9), (3, 4)):
            t = np.arange(len(data[u])) * 0.37 + 0.1
            ends = {} if mode == "clamp" else {"left": 0.0, "right": 0.0}
            assert np.allclose(got[u], np.interp(np.arange(n) / 4.5, t, data[u], **ends))


def test_hilbert_over_tiles_equals_whole(spark):
    data, df = series_df(spark, {1: 101, 2: 64, 3: 2, 4: 37, 5: 5001, 6: 1})
    got = by_utt(hilbert.magnitude(df, ["utt"], "i", "v", "m"), "i", "m")
    for u, xs in data.items():
        assert np.allclose(got[u], analytic_magnitude(xs)), u


def test_temporal_median_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(frames, "BLOCK", 4)
    rng = np.random.default_rng(3)
    data = rng.normal(size=(13, 6))
    df = spark.createDataFrame([(1, i, [float(v) for v in f]) for i, f in enumerate(data)], "utt long, i long, px array<double>")
    for window in (3, 5):
        rows = frames.temporal_median(df, ["utt"], "i", "px", window).orderBy("i").collect()
        half = window // 2
        padded = np.concatenate([data[:half][::-1], data, data[::-1][:half]])
        want = np.stack([np.median(padded[k : k + window], axis=0) for k in range(len(data))])
        assert np.allclose(np.array([r["px"] for r in rows]), want)
    short = df.where("i < 2")
    assert [r["px"] for r in frames.temporal_median(short, ["utt"], "i", "px", 3).orderBy("i").collect()] == [
        r["px"] for r in short.orderBy("i").collect()
    ]
    with pytest.raises(ValueError):
        frames.temporal_median(df, ["utt"], "i", "px", 4)


@pytest.mark.parametrize("n,shards", [(10, 3), (7, 4), (5, 8), (23, 5)])
def test_shard_sizes(spark, n, shards):
    assigned = ordering.shard_assign(spark.range(n), ["id"], shards)
    pages = ordering.shard_manifest(assigned, "id", shards).orderBy("shard").collect()
    base, rest = divmod(n, shards)
    assert {r["shard"]: r["num_files"] for r in pages} == {s: base + (s < rest) for s in range(shards)}


@pytest.mark.parametrize("limit", ["0", "1000000"])
def test_split_info_lists_every_name(spark, limit):
    """Counts, shares and whole sorted lists per split; repeated names stay, an empty split and the page size do not matter."""
    rows = [("train", f"s{k % 7}", f"u{k * 37 % 101:03d}") for k in range(90)] + [("test", f"t{k % 12}", f"u{200 + k}") for k in range(20)]
    rows += [("train", "s3", "u005"), ("train", "s3", None)]
    assigned = spark.createDataFrame(rows, "split string, subject string, utt string").repartition(5)
    spark.conf.set(scale.MAX_GROUP_ROWS_CONF, limit)
    try:
        got = summaries.split_info(assigned, "subject", "utt", {"train": 0.7, "val": 0.15, "test": 0.15}, 4).orderBy("split", "page").collect()
    finally:
        spark.conf.unset(scale.MAX_GROUP_ROWS_CONF)
    for split, ratio in (("train", 0.7), ("val", 0.15), ("test", 0.15)):
        pages = [r for r in got if r["split"] == split]
        subjects = sorted({s for k, s, _ in rows if k == split})
        utts = sorted(u for k, _, u in rows if k == split and u)
        assert [r["page"] for r in pages] == list(range(max(1, -(-len(utts) // 4))))
        assert all(len(r["subjects"]) <= 4 and len(r["utterances"]) <= 4 for r in pages)
        assert [s for r in pages for s in r["subjects"]] == subjects and [u for r in pages for u in r["utterances"]] == utts
        ends = (subjects[0], subjects[-1]) if subjects else (None, None)
        want = (len(subjects), len(utts), *ends, 19, 111, ratio, len(subjects) / 19)
        assert {tuple(r)[1:9] for r in pages} == {want}
    assert summaries.split_info(assigned.limit(0), "subject", "utt", {"train": 1.0}).count() == 0
