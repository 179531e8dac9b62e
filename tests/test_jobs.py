"""Noise reduction back to a signal, failures that stay with their utterance, and the job that can be started again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocalgrid.functions import kernels
from vocalgrid.functions.arrow import batch_kernel, guarded_kernel
from vocalgrid.operators import audio, blocks, frames, jobs, selection
from vocalgrid.sources import stores

KEYS = ["utt"]


def naive_reduction(x, rate, share, n_fft, hop, noise=None):
    window, half = kernels.hann(n_fft), n_fft // 2
    count = len(x) // hop + 1
    padded = np.concatenate([np.zeros(half), x, np.zeros(n_fft + hop)])
    spectrum = np.stack([np.fft.rfft(padded[t * hop : t * hop + n_fft] * window) for t in range(count)])
    power = np.abs(spectrum) ** 2
    if noise is None:
        end = min(int(0.5 * rate), len(x) // 4)
        noise = power[[t for t in range(count) if t * hop < end or t == 0]].mean(axis=0)
    gain = np.sqrt(np.maximum(power - share * noise, 0) / np.where(power > 0, power, 1))
    total, weight = np.zeros(len(padded) + n_fft), np.zeros(len(padded) + n_fft)
    for t in range(count):
        total[t * hop : t * hop + n_fft] += np.fft.irfft(spectrum[t] * gain[t], n_fft) * window
        weight[t * hop : t * hop + n_fft] += window**2
    total, weight = total[half : half + len(x)], weight[half : half + len(x)]
    return np.where(weight > 1e-10, total / np.maximum(weight, 1e-10), x)


@pytest.mark.parametrize("n_fft,hop,span", [(16, 4, 16), (32, 8, 64), (15, 5, 32), (16, 16, 64), (64, 16, 4096)])
def test_noise_reduction_over_blocks(spark, n_fft, hop, span):
    r = np.random.default_rng(1)
    data = {u: r.normal(size=n) for u, n in {1: 700, 2: 64, 3: 9, 4: 65, 5: 128, 6: 10}.items()}
    df = spark.createDataFrame([(u, i, float(v)) for u, x in data.items() for i, v in enumerate(x)], "utt long, i long, v double")
    out = audio.noise_reduced(blocks.from_rows(df, KEYS, "i", ["v"], span), KEYS, "v", 100.0, 0.8, n_fft, hop, span=span).orderBy("utt", "_q").collect()
    for u, x in data.items():
        own = [row for row in out if row["utt"] == u]
        assert np.allclose(np.concatenate([row["v"] for row in own]), x if len(x) < 10 else naive_reduction(x, 100.0, 0.8, n_fft, hop), atol=1e-9), u
        assert {(row["reduced"], row["error"]) for row in own} == {(len(x) >= 10, None)}


def test_noise_reduction_lowers_noise_and_keeps_the_tone(spark):
    r = np.random.default_rng(2)
    rate, n = 8000, 16000
    tone = np.where(np.arange(n) < 4000, 0.0, np.sin(2 * np.pi * 500 * np.arange(n) / rate))
    x = tone + 0.1 * r.normal(size=n)
    df = spark.createDataFrame([("u", i, float(v)) for i, v in enumerate(x)], "utt string, i long, v double")
    got = np.array([row["v"] for row in audio.noise_reduce(df, KEYS, "i", "v", float(rate)).orderBy("i").collect()])
    assert len(got) == n and np.std(got[:3500]) < 0.7 * np.std(x[:3500]) and np.corrcoef(got[5000:], tone[5000:])[0, 1] > 0.99


def test_a_noise_profile_of_ones_own(spark):
    x = np.random.default_rng(3).normal(size=200)
    df = spark.createDataFrame([("u", i, float(v)) for i, v in enumerate(x)] + [("w", i, float(v)) for i, v in enumerate(x)], "utt string, i long, v double")
    noise = np.linspace(0, 3, 9)
    profile = spark.createDataFrame([("u", noise.tolist())], "utt string, noise array<double>")
    rows = audio.noise_reduce(df, KEYS, "i", "v", 100.0, 0.5, 16, 4, profile=profile).orderBy("utt", "i").collect()
    assert np.allclose([r["v"] for r in rows if r["utt"] == "u"], naive_reduction(x, 100.0, 0.5, 16, 4, noise))
    assert np.allclose([r["v"] for r in rows if r["utt"] == "w"], x) and {(r["utt"], r["reduced"]) for r in rows} == {("u", True), ("w", False)}


def test_mel_and_mfcc_share_one_spectrum(spark):
    r = np.random.default_rng(4)
    rate, fps, hop = 8000.0, 83.28, 80
    lengths = {"a": 3 * 64 * hop, "b": 64 * hop + 3, "c": 200, "d": 1}
    df = spark.createDataFrame([(u, i, float(v)) for u, n in lengths.items() for i, v in enumerate(r.normal(size=n))], "utt string, i long, v double")
    targets = spark.createDataFrame([(u, int(n / rate * fps) + 30) for u, n in lengths.items()], "utt string, n_frames long")
    both = {(x["utt"], x["frame_idx"]): x for x in audio.mel_and_mfcc(df, KEYS, "i", "v", rate, targets, fps, 20, 8, 12, 256, hop).collect()}
    assert len(both) == sum(int(n / rate * fps) + 30 for n in lengths.values())
    spectrum = {}
    for x in audio.frame_spectrum(df, KEYS, "i", "v", 256, hop).orderBy("utt", "frame").collect():
        spectrum.setdefault(x["utt"], []).append(x["spectrum"])
    for u, n in lengths.items():
        power = np.array(spectrum[u])
        mel = power @ kernels.mel_filters(rate, 256, 20).T
        db = np.maximum(10 * np.log10(np.maximum(mel, 1e-10)) - 10 * np.log10(max(mel.max(), 1e-10)), -80)
        raw = 10 * np.log10(np.maximum(power @ kernels.mel_filters(rate, 256, 12).T, 1e-10))
        cepstra = np.maximum(raw, raw.max() - 80) @ kernels.dct_matrix(8, 12).T
        at, t = np.arange(int(n / rate * fps) + 30) / fps, np.arange(len(power)) * hop / rate
        for name, want in (("mel", db), ("mfcc", cepstra)):
            got = np.array([both[u, j][name] for j in range(len(at))])
            assert np.allclose(got, np.stack([np.interp(at, t, c) for c in want.T], axis=1), atol=1e-8), (u, name)


def test_guarded_kernel_leaves_the_others_equal(spark):
    rows = [(i, [float(i), float(i % 7)] + ([0.0] if i % 5 == 0 else [])) for i in range(60)] + [(99, None)]
    df = spark.createDataFrame(rows, "i long, x array<double>").repartition(3)

    def double(x):
        if (x[:, 0] % 11 == 3).any():
            raise ValueError("no elevens")
        return 2 * x

    made = {r["i"]: r["g"] for r in df.select("i", guarded_kernel(double)(F.col("x")).alias("g")).collect()}
    for i, x in rows:
        if x is None:
            assert made[i] is None
        elif i % 11 == 3:
            assert made[i]["value"] is None and made[i]["error"] == "ValueError: no elevens"
        else:
            assert made[i]["value"] == [2 * v for v in x] and made[i]["error"] is None
    assert df.limit(0).select(guarded_kernel(double)(F.col("x"))).collect() == []


@pytest.fixture(scope="module")
def corpus(spark):
    r = np.random.default_rng(5)
    images = [(u, i, r.random(16).tolist()) for u in range(6) for i in range(12)]
    sound = [(u, i, float(v)) for u in range(6) for i, v in enumerate(r.normal(size=40 if u < 5 else 2))]
    return spark.createDataFrame(images, "utt long, frame_idx long, px array<double>"), spark.createDataFrame(sound, "utt long, i long, v double").withColumnRenamed("i", "frame_idx")


def run(corpus, place, **more):
    arguments = {"n_fft": 8, "hop": 2, **more}
    return jobs.preprocess_store(*corpus, place, F.floor(F.col("utt") / 3), KEYS, "frame_idx", "px", "v", 4, 4, 10.0, 30.0, 50.0, **arguments)


def shown(manifest):
    return {r["utt"]: (r["offset_samples"], r["correlation"], r["error"]) for r in manifest.collect()}


def test_a_job_cut_off_goes_on_where_it_stopped(spark, corpus, tmp_path, monkeypatch):
    whole = run(corpus, str(tmp_path / "whole"))
    want = shown(whole)
    assert want[5][2] == "audio too short" and sum(e is None for *_, e in want.values()) == 5
    place, calls, shifted = str(tmp_path / "cut"), [], blocks.shifted

    def failing(*arguments, **more):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("the cluster went away")
        return shifted(*arguments, **more)

    monkeypatch.setattr(blocks, "shifted", failing)
    with pytest.raises(RuntimeError):
        run(corpus, place, parts=6)
    first = stores.read_manifest(spark, place, KEYS)
    done = {r["utt"]: r["part"] for r in first.where("error is null").collect()}
    assert 0 < len(done) < 5
    monkeypatch.setattr(blocks, "shifted", shifted)
    again = run(corpus, place, parts=6)
    assert {u: v[0::2] for u, v in shown(again).items()} == {u: v[0::2] for u, v in want.items()}
    parts = {r["utt"]: r["part"] for r in again.collect()}
    assert all(parts[u] == p for u, p in done.items())
    for what, order in (("frames", "frame_idx"), ("aligned_audio", "start")):
        sides = [[tuple(r) for r in jobs.stored(m, str(tmp_path / p), what, KEYS).orderBy("utt", order).collect()] for m, p in ((whole, "whole"), (again, "cut"))]
        assert sides[0] == sides[1] and {r[0] for r in sides[0]} == set(range(5))
    third = run(corpus, place)
    assert {r["utt"]: r["part"] for r in third.where("error is null").collect()} == {u: p for u, p in parts.items() if u != 5}
    summary = {r["subject"]: (r["total"], r["processed"], r["failed"]) for r in jobs.batch_summary(third).collect()}
    assert summary == {0: (3, 3, 0), 1: (3, 2, 1), None: (6, 5, 1)}


def test_failed_utterances_are_tried_again(corpus, tmp_path):
    blur = frames.blur_kernel(4, 4, 1.0)

    def strict(rows):
        if (rows > 0.995).any():
            raise ValueError("too bright")
        return blur(rows)

    bright = {r["utt"] for r in corpus[0].where(F.exists("px", lambda v: v > 0.995)).collect()} - {5}
    first = shown(run(corpus, str(tmp_path / "s"), blur=strict))
    assert bright and {u for u, v in first.items() if v[2] == "frames: ValueError: too bright"} == bright
    second = shown(run(corpus, str(tmp_path / "s")))
    assert {u for u, v in second.items() if v[2]} == {5}
    assert all(second[u][0] == first[u][0] for u in set(range(5)) - bright)


def test_channels(spark, corpus):
    images = corpus[0].withColumn("px", F.concat("px", F.transform("px", lambda v: 1 - v)))
    made = frames.denoise_guarded(images, KEYS, "frame_idx", "px", frames.blur_kernel(4, 4, 1.0))
    for part in (1, 17):
        alone = frames.denoise(images.withColumn("px", F.slice("px", part, 16)), KEYS, "frame_idx", "px", 4, 4)
        both = made.select("utt", "frame_idx", F.slice("px", part, 16).alias("px"))
        assert sorted(map(tuple, both.collect())) == sorted(map(tuple, alone.collect()))
    out = jobs.preprocess(images, corpus[1], KEYS, "frame_idx", "px", "v", 4, 4, 10.0, 30.0, 50.0, channels=2)
    assert sum(r["error"] is None for r in out.collect()) == 5


def test_join_reports_every_utterance_once(spark):
    left = spark.createDataFrame([(u, i, 1.0) for u, n in {1: 3, 2: 2, 3: 1}.items() for i in range(n)], "utt long, frame_idx long, f double")
    right = spark.createDataFrame([(u, i, 2.0) for u, n in {1: 3, 2: 5, 4: 1}.items() for i in range(n)], "utt long, frame_idx long, p double")
    rows, counts = selection.feature_param_report(left, right)
    assert sorted(map(tuple, rows.collect())) == [(1, i, 1.0, 2.0) for i in range(3)]
    assert {r["utt"]: r["error"] for r in counts.collect()} == {1: None, 2: "frame counts differ: 2 features, 5 parameters", 3: "no parameters", 4: "no features"}
    splits = spark.createDataFrame([(9, "train")], "utt long, split string")
    table, faults = jobs.training_tables(left, right, splits, ["p"])
    assert table.count() == 0 and {r["utt"]: r["error"] for r in faults.collect()}[1] == "no split"


def test_plain_and_guarded_kernels_agree(spark):
    df = spark.createDataFrame([(i, np.arange(6.0).tolist()) for i in range(5)], "i long, x array<double>")
    row = df.select(batch_kernel(lambda x: x + 1)(F.col("x")).alias("a"), guarded_kernel(lambda x: x + 1)(F.col("x")).alias("b")).first()
    assert row["a"] == row["b"]["value"]
