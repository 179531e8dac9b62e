"""Known cases and invariants of the operators."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocalgrid import fixed, scale
from vocalgrid.functions import columns as C
from vocalgrid.functions.arrow import pack, unpack
from vocalgrid.operators import audio, frames, geometry, jobs, ordering, pca, scores, segmentation, selection, summaries
from vocalgrid.session import new_location
from vocalgrid.sources import documents, listing, stores


def frame_table(spark, data, kind="double"):
    rows = [("u", i, [float(v) if kind == "double" else int(v) for v in f.ravel()]) for i, f in enumerate(data)]
    return spark.createDataFrame(rows, f"utt string, frame_idx long, px array<{kind}>")


def test_motion_peaks_where_a_block_appears(spark):
    data = np.zeros((50, 16, 16))
    data[25:, 4:8, 4:8] = 1.0
    rows = frames.motion_energy(frame_table(spark, data), ["utt"], "frame_idx", "px").orderBy("frame_idx").collect()
    energy = [r["energy"] for r in rows]
    assert np.argmax(energy) == 25 and energy[25] == 16 and energy[0] == 0


def test_normalize_array(spark):
    df = spark.createDataFrame([([0.0, 5.0, 10.0],), ([7.0, 7.0, 7.0],)], "a array<double>")
    got = [r[0] for r in df.select(C.normalize_array(F.col("a"))).collect()]
    assert got == [[0.0, 0.5, 1.0], [0.5, 0.5, 0.5]]
    assert df.select(C.normalize_array(F.col("a"), -1.0, 1.0)).first()[0] == [-1.0, 0.0, 1.0]


def test_pad_then_crop_is_identity(spark):
    data = np.random.default_rng(0).random((3, 7, 7))
    df = frame_table(spark, data)
    back = df.select("px", C.unpad_frame(C.pad_frame(F.col("px"), 7, 7, 11), 11, 7).alias("back")).collect()
    assert all(r["px"] == r["back"] for r in back)


def test_fixed_point_rounds_like_printf(spark):
    rng = np.random.default_rng(1)
    values = [0.0, 0.125, 0.375, 1.005, 1.015, 2.5, 0.0005, 0.0015, 1e6 + 0.125, *rng.random(300).round(4), *(rng.integers(0, 10**6, 300) / 2000)]
    values = [float(s * v) for v in values for s in (1, -1)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (2, 3):
        for r in df.select("v", C.fixed_point(F.col("v"), digits).alias("t")).collect():
            want = f"{r['v']:.{digits}f}"
            assert r["t"] == want or (r["v"] <= 0 and float(want) == 0 and r["t"].lstrip("-") == want.lstrip("-"))


def test_human_count(spark):
    df = spark.createDataFrame([(1_234_567,), (5_432,), (999,), (1_125,), (1_015,)], "n long")
    assert [r[0] for r in df.select(C.human_count(F.col("n"))).collect()] == ["1.23M", "5.43K", "999", "1.12K", "1.01K"]


def test_alignment_messages(spark):
    df = spark.createDataFrame([("a", 0.6, 0.1, 1000), ("b", 0.2, 0.1, 1000), ("c", 0.6, -9.0, 1000), ("d", 0.6, 6.0, 1000)],
                               "utt string, correlation double, offset_seconds double, n_frames long")
    got = {r["utt"]: (r["is_valid"], r["message"]) for r in selection.validate_alignment(df).collect()}
    assert got["a"] == (True, "Valid alignment: correlation=0.600")
    assert got["b"] == (False, "Low correlation: 0.200 < 0.5")
    assert got["c"] == (False, "Large offset: 9.00s (>6.00s)")
    assert got["d"][0] is True


def test_registry_prefers_and_skips(spark):
    paths = ["s1/2drt/video/a.mp4", "s1/x.avi", "s1/info.json", "s1/metadata.json", "s2/clip.mov", "s3/frames/f1.png",
             "s3/mri/f1.jpg", "s4/audio.wav", ".git/clip.mp4", "logs/clip.mp4", "s5/2drt/frames/1.jpg", "s6/2drt/video/sub/a.mp4"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r["subject_id"]: r for r in listing.corpus_registry(listing.split_path(df, "path")).collect()}
    assert set(got) == {"s1", "s2", "s3", "s5"}
    assert got["s1"]["mri_path"] == "s1/2drt/video" and got["s1"]["metadata_path"] == "s1/metadata.json"
    assert (got["s2"]["mri_path"], got["s2"]["mri_format"]) == ("s2", "video_dir")
    assert (got["s3"]["mri_path"], got["s3"]["audio_path"]) == ("s3/frames", None)
    assert got["s5"]["mri_path"] == "s5/2drt/frames"


def test_manifest_without_utterances(spark):
    text = '{"subjects": [{"subject_id": "a", "utterances": [{"utterance_name": "a_1", "correlation": 0.4}]}, {"subject_id": "b"}]}'
    df = spark.createDataFrame([(text,)], "t string").select(F.from_json("t", documents.MANIFEST_SCHEMA).alias("d")).select("d.*")
    assert [(r["subject_id"], r["utterance_name"]) for r in documents.explode_manifest(df).collect()] == [("a", "a_1")]


def test_big_subject_takes_several_documents(spark):
    df = spark.range(1000).select(F.lit("s").alias("subject"), F.col("id").alias("utt"))
    nested = documents.nest_manifest(df, "subject", "utt", [F.col("utt").alias("utterance_name")], per_document=100)
    sizes = [len(r["subjects"][0]["utterances"]) for r in nested.collect()]
    assert sum(sizes) == 1000 and max(sizes) < 200


def test_splits_are_whole_disjoint_and_checked(spark):
    df = spark.range(15).select(F.format_string("sub%03d", F.col("id").cast("int")).alias("subject"))
    got = ordering.subject_split(df, "subject").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 10, "val": 2, "test": 3}
    other = ordering.label_dir_split(df, "subject", 0.15, 0.15).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in other} == {"train": 11, "val": 2, "test": 2}
    assert ordering.split_leaks(ordering.subject_split(df, "subject"), "subject").count() == 0
    with pytest.raises(ValueError):
        ordering.subject_split(df, "subject", 0.5, 0.1, 0.1)
    seeds = [tuple(r[0] for r in ordering.subject_split(df, "subject", seed=s).where("split = 'test'").orderBy("subject").collect()) for s in (1, 1, 2)]
    assert seeds[0] == seeds[1] != seeds[2]


def test_geometry_kernel_sql_and_packed_agree(spark):
    data = np.random.default_rng(2).integers(0, 4, (20, 9, 11))
    data[0] = 0
    df = frame_table(spark, data, "int")
    key = ["utt", "frame_idx"]
    wide = geometry.geometric_features(df, key, "px", 9, 11).orderBy("frame_idx").collect()
    packed = geometry.geometric_features(df.withColumn("px", pack()(F.col("px"))), key, "px", 9, 11).orderBy("frame_idx").collect()
    sql = geometry.geometric_features_sql(df, key, "px", 9, 11).orderBy("frame_idx").collect()
    assert wide == packed
    assert all(np.allclose(a[2:], b[2:]) for a, b in zip(wide, sql)) and len(sql) == 20
    assert df.select(unpack()(pack()(F.col("px"))).alias("b"), "px").where("b <> px").count() == 0


def test_dice_of_absent_class_is_one(spark):
    df = spark.createDataFrame([(1, [0, 1, 1, 2], [0, 1, 2, 2])], "k long, p array<int>, t array<int>")
    got = {r["cls"]: r for r in scores.dice_iou(df, ["k"], "p", "t", 4).collect()}
    assert np.isclose(got[1]["dice"], 2 / 3) and np.isclose(got[3]["dice"], 1.0) and np.isclose(got[0]["iou"], 1.0)
    assert got[0]["pixel_accuracy"] == 0.75


def test_constant_parameter_has_no_pearson(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.5), (3.0, 5.5)], "a double, b double")
    only_flat = summaries.regression_metrics(df, {"x": (F.col("a") * 0, F.col("b"))}, F.lit(True)).first()
    assert only_flat["pearson"] == 0.0
    both = summaries.regression_metrics(df, {"x": (F.col("a") * 0, F.col("b")), "y": (F.col("a"), F.col("b"))}, F.lit(True)).first()
    assert np.isclose(both["pearson"], np.corrcoef([1, 2, 3], [2, 4.5, 5.5])[0, 1])


def test_spectrum_equals_numpy_over_blocks(spark):
    rng = np.random.default_rng(3)
    for n in (5, 64 * 40, 64 * 40 + 13, 7000):
        x = rng.normal(size=n)
        df = spark.createDataFrame([("u", i, float(v)) for i, v in enumerate(x)], "utt string, i long, v double")
        rows = audio.frame_spectrum(df, ["utt"], "i", "v", n_fft=64, hop=40).orderBy("frame").collect()
        padded = np.pad(x, 32)
        window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(64) / 64)
        want = [np.abs(np.fft.rfft(padded[t * 40 : t * 40 + 64] * window)) ** 2 for t in range(1 + n // 40)]
        assert [r["frame"] for r in rows] == list(range(1 + n // 40))
        assert np.allclose([r["spectrum"] for r in rows], want)
        blocks = scale.to_blocks(df, ["utt"], "i", "v", audio.FRAMES_PER_BLOCK * 40)
        again = audio.frame_spectrum(blocks, ["utt"], "i", "v", n_fft=64, hop=40).orderBy("frame").collect()
        assert np.allclose([r["spectrum"] for r in again], want)


def align_by_numpy(energy, sound):
    """Offset and peak of two series on one clock, restated on whole arrays (sigma: one sample)."""
    from tests.brute import analytic_magnitude
    from vocalgrid.functions.kernels import gaussian

    def smooth(x):
        place = np.arange(-4, len(x) + 4) % (2 * len(x))
        return np.convolve(x[np.where(place < len(x), place, 2 * len(x) - 1 - place)], gaussian(4, 1.0), "valid")

    unit = lambda v: (v - v.min()) / (v.max() - v.min() + 1e-8)
    z = lambda v: (v - v.mean()) / (v.std() + 1e-8)
    n = max(len(energy), len(sound))
    e = np.pad(unit(smooth(energy)), (0, n - len(energy)))
    a = np.pad(z(unit(smooth(analytic_magnitude(sound)))), (0, n - len(sound)))
    products = np.correlate(a, z(e), "same")
    return products.argmax() - n // 2, products.max() / n


def test_late_audio_has_positive_offset(spark):
    t = np.arange(120)
    energy = np.abs(1 + np.sin(t * t / 300.0) + 0.5 * np.sin(t / 5.0))
    energy[0] = 0.0
    data = np.zeros((120, 2, 2))
    data[:, 0, 0] = np.cumsum(energy)
    images = frame_table(spark, data)
    sound = np.concatenate([np.zeros(7), energy]) * np.cos(np.pi * 0.5 * np.arange(127))
    df = spark.createDataFrame([("u", i, float(v)) for i, v in enumerate(sound)], "utt string, frame_idx long, v double")
    got = jobs.align(images, df, ["utt"], "frame_idx", "px", "v", 50.0, 50.0, 20.0).first()
    offset, peak = align_by_numpy(energy, sound)
    assert got["offset_samples"] == offset == 7 and np.isclose(got["correlation"], peak)
    moved = jobs.aligned_audio(df, spark.createDataFrame([got]), ["utt"], "frame_idx", "v", 50.0, 50.0)
    assert [r["v"] for r in moved.orderBy("frame_idx").collect()] == [float(v) for v in sound[7:127]]


def test_offset_near_half_the_length_and_region(spark):
    rng = np.random.default_rng(9)
    energy = rng.random(300)
    energy[0] = 0.0
    data = np.zeros((300, 2, 2))
    data[:, 0, 0] = np.cumsum(energy)
    data[:, 1, 1] = rng.random(300) * 100
    images = frame_table(spark, data)
    sound = np.concatenate([np.zeros(290), energy]) * np.cos(np.pi * 0.5 * np.arange(590))
    df = spark.createDataFrame([("u", i, float(v)) for i, v in enumerate(sound)], "utt string, frame_idx long, v double")
    got = jobs.align(images, df, ["utt"], "frame_idx", "px", "v", 50.0, 50.0, 20.0, width=2, roi=(0, 1, 0, 1)).first()
    offset, peak = align_by_numpy(energy, sound)
    assert got["offset_samples"] == offset == 290 and np.isclose(got["correlation"], peak)
    times = jobs.frame_times(images, ["utt"], "frame_idx", 50.0).orderBy("frame_idx").collect()
    assert [r["timestamp"] for r in times[:3]] == [0.0, 0.02, 0.04] and len(times) == 300


def test_static_and_silent_input(spark):
    images = frame_table(spark, np.full((30, 2, 2), 0.5))
    silent = spark.createDataFrame([("u", i, 0.0) for i in range(40)], "utt string, frame_idx long, v double")
    got = jobs.align(images, silent, ["utt"], "frame_idx", "px", "v", 10.0, 13.0, 50.0).first()
    assert got["correlation"] == 0.0


def test_ledger_keeps_the_run_going(spark):
    images = frame_table(spark, np.random.default_rng(5).random((12, 8, 8))).unionByName(
        frame_table(spark, np.zeros((3, 8, 8))).withColumn("utt", F.lit("lonely"))
    )
    sound = spark.createDataFrame([("u", i, float(i % 5)) for i in range(20)], "utt string, frame_idx long, v double")
    got = {r["utt"]: r for r in jobs.preprocess(images, sound, ["utt"], "frame_idx", "px", "v", 8, 8, 10.0, 13.0, 50.0).collect()}
    assert got["lonely"]["error"] == "no audio" and got["u"]["error"] is None and got["u"]["n_frames"] == 12


def test_pca_equals_svd(spark):
    rng = np.random.default_rng(6)
    data = rng.integers(0, 4, (200, 4, 5))
    df = frame_table(spark, data, "int")
    flat = data.reshape(200, -1).astype(float)
    centred = flat - flat.mean(axis=0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    model = pca.fit(df, "px", 4, 5, 6)
    assert np.allclose(np.abs(model.components), np.abs(vt[:6]), atol=1e-6)
    assert np.allclose(model.explained_ratio, (s**2 / (s**2).sum())[:6])
    rows = df.select("frame_idx", pca.transform(model, F.col("px")).alias("z")).orderBy("frame_idx").collect()
    assert np.allclose([r["z"] for r in rows], centred @ model.components.T)
    white = dataclasses.replace(model, whiten=True)
    rows = df.select(pca.transform(white, F.col("px")).alias("z")).collect()
    assert np.allclose(np.std([r["z"] for r in rows], axis=0, ddof=1), 1.0)
    full = pca.fit(df, "px", 4, 5, 20)
    back = df.select("px", pca.inverse(full, F.transform(pca.transform(full, F.col("px")), lambda v: v)).alias("b"))
    close = [np.abs(np.array(r["px"]) - np.array(r["b"])).max() for r in back.collect()]
    assert max(close) <= 1  # truncation may take a whole class that came back a hair too small
    with pytest.raises(Exception, match="masks must hold"):
        df.select(pca.transform(model, F.slice("px", 1, 10))).collect()


def test_pca_goes_on_until_the_components_hold(spark):
    r = np.random.default_rng(3)
    turned = np.linalg.qr(r.standard_normal((100, 100)))[0]
    data = (r.standard_normal((400, 100)) * np.exp(-np.arange(100) / 100)) @ turned
    df = spark.createDataFrame([(x.tolist(),) for x in data], "px array<double>")
    model = pca.fit(df, "px", 10, 10, 3, max_steps=3, passes=None)
    values, vectors = np.linalg.eigh(np.cov(data.T))
    assert np.allclose(model.variances, values[::-1][:3], rtol=1e-10)
    assert np.allclose(np.abs((model.components * vectors[:, ::-1][:, :3].T).sum(axis=1)), 1, atol=1e-10)


@pytest.mark.parametrize("decay", [5, 50, 300])
def test_pca_takes_few_scans_and_tells_its_error(spark, monkeypatch, decay):
    r = np.random.default_rng(4)
    size, k = 400, 5
    turned = np.linalg.qr(r.standard_normal((size, size)))[0]
    data = (r.standard_normal((900, size)) * np.exp(-np.arange(size) / decay)) @ turned
    df = spark.createDataFrame([(x.tolist(),) for x in data], "px array<double>").repartition(3)
    scans, applied = [], pca._applied
    monkeypatch.setattr(pca, "_applied", lambda *a: (scans.append(1), applied(*a))[1])
    model = pca.fit(df, "px", 20, 20, k)
    true = np.linalg.eigvalsh(np.cov(data.T))[::-1]
    assert len(scans) <= 3 and np.isclose(model.total, true.sum())
    off = np.abs(model.variances[:, None] - true).min(axis=1)
    assert (off <= model.bound * model.variances[0] + 1e-9).all() and model.bound < {5: 1e-4, 50: 0.1, 300: 0.2}[decay]
    assert np.allclose(model.variances, true[:k], rtol={5: 1e-8, 50: 1e-2, 300: 0.1}[decay])


def test_pca_of_large_frames_in_few_directions(spark):
    """256 x 256 pixels: four patterns under noise, packed masks, a null mask left out."""
    rng = np.random.default_rng(8)
    side, n = 256, 60
    patterns = rng.random((4, side * side)) < 0.5
    data = (rng.random((n, 4)) < 0.5).astype(np.uint8) @ patterns.astype(np.uint8)
    rows = [(i, bytearray(m.tobytes())) for i, m in enumerate(data)] + [(n, None)]
    df = spark.createDataFrame(rows, "frame_idx long, px binary").repartition(4)
    centred = data.astype(float) - data.mean(axis=0)
    s = np.linalg.svd(centred, compute_uv=False)
    model = pca.fit(df, "px", side, side, 4)
    assert np.allclose(model.variances, s[:4] ** 2 / (n - 1))
    assert np.isclose(model.total, (s**2).sum() / (n - 1))
    got = {r["frame_idx"]: r["z"] for r in df.select("frame_idx", pca.transform(model, F.col("px")).alias("z")).collect()}
    assert got.pop(n) is None
    assert np.allclose([got[i] for i in range(n)], centred @ model.components.T, atol=1e-6)


def test_pca_of_equal_masks(spark):
    model = pca.fit(frame_table(spark, np.full((5, 2, 2), 2), "int"), "px", 2, 2, 3, whiten=True)
    assert np.allclose(model.explained_ratio, 0) and np.allclose(model.mean, 2)
    df = frame_table(spark, np.full((1, 2, 2), 2), "int").select(pca.transform(model, F.col("px")).alias("z"))
    assert np.allclose(df.first()["z"], 0)
    with pytest.raises(ValueError, match="no masks"):
        pca.fit(frame_table(spark, np.full((1, 2, 2), 2), "int").where("false"), "px", 2, 2, 1)


def test_vocal_tract_of_nothing_is_everything(spark):
    df = frame_table(spark, np.zeros((1, 6, 6)), "int")
    assert df.select(segmentation.vocal_tract_mask(6, 6)(F.col("px")).alias("t")).first()["t"] == [1] * 36


def test_pseudo_label_methods(spark):
    df = frame_table(spark, np.random.default_rng(7).random((4, 10, 10)))
    for method in ("combined", "otsu"):
        rows = segmentation.pseudo_labels(df, "px", 10, 10, method).select("label").collect()
        assert {v for r in rows for v in r["label"]} <= {0, 1, 2, 3}
    with pytest.raises(ValueError):
        segmentation.pseudo_labels(df, "px", 10, 10, "other")


def test_stores(spark):
    where = new_location(spark, "store")
    df = spark.range(100).select((F.col("id") % 3).alias("subject"), F.col("id").alias("frame_idx"), (F.col("id") * 2).alias("v"))
    stores.write_utterances(df, where, ["subject"], ["frame_idx"])
    back = stores.read_utterances(spark, where, ["frame_idx", "v", "unknown"])
    assert back.columns == ["frame_idx", "v"] and back.count() == 100
    plan = stores.read_utterances(spark, where).where("subject = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(subject" in plan


def test_training_table_statistics(spark):
    feats = spark.range(60).select((F.col("id") / 6).cast("long").alias("utt"), (F.col("id") % 6).alias("frame_idx"), F.rand(1).alias("f"))
    params = feats.select("utt", "frame_idx", (F.col("utt") * 10 + F.col("frame_idx")).cast("double").alias("p"), F.lit(3.0).alias("flat"))
    splits = spark.range(10).select(F.col("id").alias("utt"), F.when(F.col("id") < 7, "train").otherwise("val").alias("split"))
    for mode in ("train", "split"):
        out = jobs.training_table(feats, params, splits, ["p", "flat"], stats_from=mode)
        stat = {r["split"]: r for r in out.groupBy("split").agg(F.avg("p_z").alias("m"), F.stddev_pop("p_z").alias("s"), F.max("flat_z").alias("z")).collect()}
        assert abs(stat["train"]["m"]) < 1e-9 and abs(stat["train"]["s"] - 1) < 1e-9 and stat["train"]["z"] == 0
        assert (abs(stat["val"]["m"]) < 1e-9) == (mode == "split")


def test_frame_transform_changes_both(spark):
    df = frame_table(spark, np.random.default_rng(8).random((3, 2, 3))).withColumn("mask", F.transform("px", lambda v: (v > 0.5).cast("int")))
    out = frames.frame_transform(df, "px", "mask", lambda i, m: (i[:, ::-1], m[:, ::-1])).orderBy("frame_idx").collect()
    first = df.orderBy("frame_idx").collect()
    assert all(a["px"] == b["px"][::-1] and a["mask"] == b["mask"][::-1] for a, b in zip(first, out))


def test_tiers(spark):
    df = spark.createDataFrame([(0.4,), (0.3,), (0.2,), (0.1,), (0.09,), (0.4649,)], "c double")
    got = [r[0] for r in df.select(C.quality_tier(F.col("c"))).collect()]
    assert got == ["EXCELLENT", "GOOD", "MODERATE", "ACCEPTABLE", "POOR", "EXCELLENT"]
    assert len(fixed.GEOMETRIC_FEATURES) == 14
