"""Queries on sampled series and their spectra."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalgrid import scale
from vocalgrid.functions import columns as C
from vocalgrid.functions import kernels
from vocalgrid.operators import audio, hilbert, jobs, series
from vocalgrid.plans import binding as B
from vocalgrid.plans.catalog import d6, query
from vocalgrid.session import pinned

UTT = ["utt"]


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[C.r6(F.col(c)).alias(c) if c in names else F.col(c) for c in df.columns])


# SQL pieces: each makes CTEs from a table (utt, i, v) --------------------------------------------


def smooth_sql(source: str, out: str, weights) -> str:
    """Weighted sum over reflected neighbours."""
    half = len(weights) // 2
    rows = ", ".join(f"({i - half}, {float(w)!r}::DOUBLE)" for i, w in enumerate(weights))
    turn = "(((s.i + k.k) % (2 * n.n) + 2 * n.n) % (2 * n.n))"
    return f"""{out}_n AS (SELECT utt, count(*) AS n FROM {source} GROUP BY utt),
{out}_k(k, w) AS (VALUES {rows}),
{out} AS (SELECT s.utt, s.i, sum(k.w * q.v) AS v FROM {source} s JOIN {out}_n n USING (utt), {out}_k k
  JOIN {source} q ON q.utt = s.utt AND q.i = CASE WHEN {turn} < n.n THEN {turn} ELSE 2 * n.n - 1 - {turn} END GROUP BY s.utt, s.i)"""


def minmax_sql(source: str, out: str) -> str:
    return f"""{out} AS (SELECT utt, i, (v - min(v) OVER (PARTITION BY utt)) / (max(v) OVER (PARTITION BY utt) - min(v) OVER (PARTITION BY utt) + 1e-8) AS v FROM {source})"""


def zscore_sql(source: str, out: str) -> str:
    return f"""{out} AS (SELECT utt, i, (v - avg(v) OVER (PARTITION BY utt)) / (stddev_pop(v) OVER (PARTITION BY utt) + 1e-8) AS v FROM {source})"""


def interpolate_sql(source: str, out: str, targets: str, rate: float, mode: str) -> str:
    """source: utt, i, t, v; targets: utt, m."""
    low, high = ("0.0::DOUBLE", "0.0::DOUBLE") if mode == "zero" else ("s.v", "s.v")
    return f"""{out}_s AS (SELECT utt, i, t, v, lead(t) OVER w AS t1, lead(v) OVER w AS v1 FROM {source} WINDOW w AS (PARTITION BY utt ORDER BY i)),
{out}_p AS (SELECT utt, j, j / {rate!r}::DOUBLE AS at FROM (SELECT utt, unnest(range(0, m)) AS j FROM {targets})),
{out} AS (SELECT p.utt, p.j AS i, CASE WHEN p.at < s.t THEN {low} WHEN s.t1 IS NULL THEN CASE WHEN p.at > s.t THEN {high} ELSE s.v END
    ELSE s.v + (s.v1 - s.v) * ((p.at - s.t) / (s.t1 - s.t)) END AS v
  FROM {out}_p p JOIN {out}_s s ON s.utt = p.utt AND (p.at >= s.t OR s.i = 0) AND (s.t1 IS NULL OR p.at < s.t1))"""


def hilbert_sql(source: str, out: str) -> str:
    """Magnitude of the analytic signal by direct circular convolution."""
    d = "((a.i - b.i) % n.n + n.n) % n.n"
    return f"""{out}_n AS (SELECT utt, count(*) AS n FROM {source} GROUP BY utt),
{out}_h AS (SELECT a.utt, a.i, a.v, sum(b.v * CASE WHEN {d} = 0 THEN 0
    WHEN n.n % 2 = 0 THEN CASE WHEN ({d}) % 2 = 1 THEN 2.0 / n.n / tan(pi() * ({d}) / n.n) ELSE 0 END
    ELSE (cos(pi() * ({d}) / n.n) - CASE WHEN ({d}) % 2 = 0 THEN 1 ELSE -1 END) / sin(pi() * ({d}) / n.n) / n.n END) AS h
  FROM {source} a JOIN {out}_n n USING (utt) JOIN {source} b ON b.utt = a.utt GROUP BY a.utt, a.i, a.v),
{out} AS (SELECT utt, i, sqrt(v * v + h * h) AS v FROM {out}_h)"""


SERIES_SQL = f"{B.SIGNAL_SQL}, series AS (SELECT utt, frame_idx AS i, value AS v FROM signal)"
SMOOTH_MS, SMOOTH_RATE = 50.0, 40.0
SMOOTH = series.gaussian_weights(SMOOTH_MS / 1000 * SMOOTH_RATE)


@query("gaussian_smooth", f"WITH {SERIES_SQL}, {smooth_sql('series', 's', SMOOTH)} SELECT utt, CAST(i AS BIGINT) AS frame_idx, {d6('v')} AS smoothed FROM s")
def gaussian_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.gaussian_smooth(B.samples(spark, sf_dir), UTT, "frame_idx", "value", SMOOTH_MS, SMOOTH_RATE), "smoothed")


@query("group_minmax", f"WITH {SERIES_SQL}, {minmax_sql('series', 's')} SELECT utt, CAST(i AS BIGINT) AS frame_idx, {d6('v')} AS scaled FROM s")
def group_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.group_minmax(B.samples(spark, sf_dir), UTT, "frame_idx", "value").drop("value"), "scaled")


@query("linspace_sample", f"""WITH {B.SIGNAL_SQL}, picks AS (SELECT utt, unnest(range(0, 12)) AS i, n FROM sized)
  SELECT p.utt, CAST(p.i AS BIGINT) AS sample, CAST(s.frame_idx AS BIGINT) AS frame_idx, s.value FROM picks p JOIN signal s ON s.utt = p.utt AND s.frame_idx = p.i * (p.n - 1) // 11""")
def linspace_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = B.samples(spark, sf_dir)
    picks = series.linspace_positions(scale.group_size(df, UTT), "n", 12).drop("n")
    return picks.withColumn("sample", F.col("sample").cast("long")).join(df, ["utt", "frame_idx"])


SIX_HOURS = 21600e6
TIMED_SQL = f"""{B.SIGNAL_SQL}, timed AS (SELECT utt, frame_idx AS i, value AS v,
    (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY utt)) / {SIX_HOURS!r}::DOUBLE AS t FROM signal),
targets AS (SELECT utt, CAST(floor(max(t) * 1.5) AS BIGINT) + 4 AS m FROM timed GROUP BY utt)"""


def timed_samples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Samples with irregular times since the utterance's start, and the target count per utterance."""
    df = B.signal(spark, sf_dir).select("utt", "frame_idx", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    ends = df.groupBy("utt").agg(F.min("us").alias("us0"), F.max("us").alias("us1"))
    span = (F.col("us1") - F.col("us0")) / F.lit(SIX_HOURS)
    targets = ends.select("utt", (F.floor(span * 1.5) + 4).alias("n_targets"))
    timed = scale.attach(df, ends.select("utt", "us0"), UTT, ["frame_idx"])
    return timed.withColumn("t", (F.col("us") - F.col("us0")) / F.lit(SIX_HOURS)), targets


@query("interp_asof", f"""WITH {TIMED_SQL}, {interpolate_sql('timed', 'clamped', 'targets', 1.5, 'clamp')}, {interpolate_sql('timed', 'zeroed', 'targets', 1.5, 'zero')}
  SELECT utt, CAST(i AS BIGINT) AS target_idx, {d6('c.v')} AS clamped, {d6('z.v')} AS zeroed FROM clamped c JOIN zeroed z USING (utt, i)""")
def interp_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed, targets = timed_samples(spark, sf_dir)
    parts = [
        series.interpolate(timed, UTT, "frame_idx", "t", ["value"], targets, 1.5, mode).withColumnRenamed("value", name)
        for mode, name in (("clamp", "clamped"), ("zero", "zeroed"))
    ]
    return rounded(parts[0].join(parts[1], ["utt", "target_idx"]), "clamped", "zeroed")


@query("lag_join", f"""WITH {B.SIGNAL_SQL}, ab AS (SELECT utt, frame_idx AS i, value AS a, CAST(json_extract(props, '$.k') AS DOUBLE) AS b FROM signal),
  lags AS (SELECT utt, unnest(range(1 - count(*), count(*))) AS lag FROM ab GROUP BY utt),
  s AS (SELECT p.utt, lag, sum(coalesce(q.a, 0) * p.b) AS total FROM ab p JOIN lags USING (utt) LEFT JOIN ab q ON q.utt = p.utt AND q.i = p.i + lag GROUP BY p.utt, lag),
  r AS (SELECT *, row_number() OVER (PARTITION BY utt ORDER BY total DESC, lag) = 1 AS is_best FROM s)
  SELECT utt, CAST(lag AS BIGINT) AS lag, {d6('total')} AS total, is_best FROM r""")
def lag_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = B.signal(spark, sf_dir).withColumn("b", F.get_json_object("props", "$.k").cast("double"))
    # Read for the best lag and for all of them.
    products = pinned(series.lag_products(df, UTT, "frame_idx", "value", "b"))
    best = series.best_lag(products, UTT).select("utt", F.col("lag").alias("best"))
    marked = products.join(best, "utt").withColumn("is_best", F.col("lag") == F.col("best"))
    return rounded(marked.drop("best"), "total")


def shift_plan(df: DataFrame) -> DataFrame:
    return scale.group_size(df, UTT).select(
        "utt", (F.col("utt") % 7 - 3).alias("offset"), (F.col("n") + F.col("utt") % 5 - 2).alias("out_len")
    )


def shift_sql(sign: str) -> str:
    return f"""WITH {B.SIGNAL_SQL}, o AS (SELECT utt, utt % 7 - 3 AS o, n + utt % 5 - 2 AS len FROM sized),
  g AS (SELECT utt, o, unnest(range(0, len)) AS i FROM o)
  SELECT g.utt, CAST(g.i AS BIGINT) AS frame_idx, coalesce(s.value, 0) AS value FROM g LEFT JOIN signal s ON s.utt = g.utt AND s.frame_idx = g.i {sign} g.o"""


@query("shift_series", shift_sql("+"))
def shift_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = B.samples(spark, sf_dir)
    return series.shift_series(df, UTT, "frame_idx", "value", shift_plan(df))


@query("shift_series_compat", shift_sql("-"))
def shift_series_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = B.samples(spark, sf_dir)
    return series.shift_series(df, UTT, "frame_idx", "value", shift_plan(df), compat=True)


DB_SQL = "10 * log10(greatest({p}, 1e-10)) - 10 * log10(greatest({r}, 1e-10))"


@query("power_to_db", f"""SELECT user_id AS utt, event_id, {d6('greatest(' + DB_SQL.format(p='pow(value / 500, 8)', r='max(pow(value / 500, 8)) OVER (PARTITION BY user_id)') + ', -80)')} AS db FROM events""")
def power_to_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = B.table(spark, sf_dir, "events").select(F.col("user_id").alias("utt"), "event_id", F.pow(F.col("value") / 500, 8).alias("p"))
    return rounded(series.group_db(events, UTT, "event_id", "p").drop("p"), "db")


@query("downmix", f"SELECT user_id AS utt, CAST(event_id // 2000 AS BIGINT) AS sample, {d6('avg(value)')} AS mono FROM events GROUP BY ALL")
def downmix(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = B.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("utt"), F.floor(F.col("event_id") / 2000).cast("long").alias("sample"), "value"
    )
    return rounded(series.downmix(events, UTT, "sample", "value"), "mono")


@query("signal_chunks", f"""WITH {B.SIGNAL_SQL} SELECT utt, CAST(frame_idx AS BIGINT) AS frame_idx, value, CAST(frame_idx // 20 AS BIGINT) AS chunk,
    utt || '_seq' || (frame_idx // 20) AS sequence, CAST(frame_idx // 20 * 20 AS BIGINT) AS start_idx, CAST(frame_idx // 20 * 20 + 20 AS BIGINT) AS end_idx
  FROM signal JOIN sized USING (utt) WHERE frame_idx // 20 < n // 20""")
def signal_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vocalgrid.operators.ordering import sequence_chunks

    return sequence_chunks(B.samples(spark, sf_dir), "utt", "frame_idx", 20)


# Spectra ----------------------------------------------------------------------------------------

N_FFT, HOP, RATE, FPS = 16, 4, 8000.0, 1700.0


def spectrum_sql(power: float = 2.0) -> str:
    """spec(utt, t, b, p): power per frame and bin by a direct transform."""
    return f"""{B.SIGNAL_SQL},
fr AS (SELECT utt, unnest(range(0, n // {HOP} + 1)) AS t FROM sized),
win AS (SELECT f.utt, f.t, k.k, s.value / 7 * (0.5 - 0.5 * cos(2 * pi() * k.k / {N_FFT})) AS x
  FROM fr f, (SELECT unnest(range(0, {N_FFT})) AS k) k JOIN signal s ON s.utt = f.utt AND s.frame_idx = f.t * {HOP} - {N_FFT // 2} + k.k),
spec AS (SELECT utt, t, b, pow(sqrt(sum(x * cos(2 * pi() * k * b / {N_FFT})) ** 2 + sum(x * sin(2 * pi() * k * b / {N_FFT})) ** 2), {power}) AS p
  FROM win, (SELECT unnest(range(0, {N_FFT // 2 + 1})) AS b) GROUP BY utt, t, b)"""


def matrix_sql(name: str, matrix: np.ndarray) -> str:
    cells = ", ".join(f"({i}, {j}, {float(v)!r}::DOUBLE)" for i, row in enumerate(matrix) for j, v in enumerate(row))
    return f"{name}(i, j, w) AS (VALUES {cells})"


def sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples over seven: powers then never end on the digit that rounding hangs on."""
    return B.samples(spark, sf_dir).withColumn("value", F.col("value") / 7)


def bins(df: DataFrame, keys: list[str], column: str, index: str, value: str) -> DataFrame:
    rows = df.select(*keys, F.posexplode(column).alias(index, value))
    return rows.select(*keys, F.col(index).cast("long").alias(index), C.r6(F.col(value)).alias(value))


@query("frame_spectrum", f"WITH {spectrum_sql()} SELECT utt, CAST(t AS BIGINT) AS frame, CAST(b AS BIGINT) AS bin, {d6('p')} AS power FROM spec")
def frame_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audio.frame_spectrum(sound(spark, sf_dir), UTT, "frame_idx", "value", N_FFT, HOP)
    return bins(out, ["utt", "frame"], "spectrum", "bin", "power")


N_MELS, N_MFCC_MELS, N_MFCC = 4, 5, 3


def mel_sql(n_mels: int) -> str:
    return f"""{spectrum_sql()}, {matrix_sql('bank', kernels.mel_filters(RATE, N_FFT, n_mels))},
mel AS (SELECT utt, t, i AS band, sum(w * p) AS p FROM spec JOIN bank ON j = b GROUP BY utt, t, i),
targets AS (SELECT utt, CAST(floor(n / {RATE!r}::DOUBLE * {FPS!r}::DOUBLE) AS BIGINT) + 2 AS m FROM sized)"""


def banded_interpolation_sql(source: str, out: str) -> str:
    """Interpolation per (utt, band): the band rides in a combined key."""
    return f"""{out}_src AS (SELECT utt * 1000 + band AS utt, t AS i, t * {float(HOP)!r}::DOUBLE / {RATE!r}::DOUBLE AS t, v FROM {source}),
{out}_tgt AS (SELECT DISTINCT utt * 1000 + band AS utt, m FROM {source} JOIN targets USING (utt)),
{interpolate_sql(f'{out}_src', out, f'{out}_tgt', FPS, 'clamp')}"""


def frame_targets(df: DataFrame) -> DataFrame:
    n = F.floor(F.col("n") / F.lit(RATE) * F.lit(FPS)) + 2
    return scale.group_size(df, UTT).select("utt", n.alias("n_frames"))


@query("mel_features", f"""WITH {mel_sql(N_MELS)}, db AS (SELECT utt, t, band, greatest({DB_SQL.format(p='p', r='max(p) OVER (PARTITION BY utt)')}, -80) AS v FROM mel),
  {banded_interpolation_sql('db', 'o')}
  SELECT CAST(utt // 1000 AS BIGINT) AS utt, CAST(i AS BIGINT) AS frame_idx, CAST(utt % 1000 AS BIGINT) AS band, {d6('v')} AS db FROM o""")
def mel_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sound(spark, sf_dir)
    out = audio.mel_features(df, UTT, "frame_idx", "value", RATE, frame_targets(df), FPS, N_MELS, N_FFT, HOP)
    return bins(out, ["utt", "frame_idx"], "mel", "band", "db")


@query("mfcc_features", f"""WITH {mel_sql(N_MFCC_MELS)}, db0 AS (SELECT utt, t, band, 10 * log10(greatest(p, 1e-10)) AS v FROM mel),
  db AS (SELECT utt, t, band, greatest(v, max(v) OVER (PARTITION BY utt) - 80) AS v FROM db0),
  ks AS (SELECT unnest(range(0, {N_MFCC})) AS k),
  cep AS (SELECT utt, t, k AS band, sum(v * cos(pi() * k * (2 * band + 1) / (2 * {N_MFCC_MELS})))
      * sqrt(CASE WHEN k = 0 THEN 1.0 ELSE 2.0 END / {N_MFCC_MELS}) AS v FROM db, ks GROUP BY utt, t, k),
  {banded_interpolation_sql('cep', 'o')}
  SELECT CAST(utt // 1000 AS BIGINT) AS utt, CAST(i AS BIGINT) AS frame_idx, CAST(utt % 1000 AS BIGINT) AS coefficient, {d6('v')} AS value FROM o""")
def mfcc_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sound(spark, sf_dir)
    out = audio.mfcc_features(df, UTT, "frame_idx", "value", RATE, frame_targets(df), FPS, N_MFCC, N_MFCC_MELS, N_FFT, HOP)
    return bins(out, ["utt", "frame_idx"], "mfcc", "coefficient", "value")


@query("noise_subtract", f"""WITH {spectrum_sql()}, e AS (SELECT utt, least(50, n // 4) AS e, CASE WHEN n >= 10 THEN 0.8::DOUBLE ELSE 0 END AS share FROM sized),
  noise AS (SELECT utt, b, share, avg(p) AS q FROM spec JOIN e USING (utt) WHERE t * {HOP} < e OR t = 0 GROUP BY utt, b, share)
  SELECT utt, CAST(t AS BIGINT) AS frame, CAST(b AS BIGINT) AS bin, {d6('greatest(p - share * q, 0)')} AS power FROM spec JOIN noise USING (utt, b)""")
def noise_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audio.noise_subtract(sound(spark, sf_dir), UTT, "frame_idx", "value", 100.0, 0.8, N_FFT, HOP)
    return bins(out, ["utt", "frame"], "spectrum", "bin", "power")


def noise_reduce_sql(source: str, out: str, rate: float, n_fft: int, hop: int, share: float = 0.8) -> str:
    """out(utt, i, v, reduced) from source(utt, i, v): spectral subtraction and windowed overlap-add by direct sums."""
    half, hann = n_fft // 2, f"(0.5 - 0.5 * cos(2 * pi() * k.k / {n_fft}))"
    turn = f"2 * pi() * k.k * b.b / {n_fft}"
    return f"""{out}_n AS (SELECT utt, count(*) AS n, least({int(0.5 * rate)}, count(*) // 4) AS e FROM {source} GROUP BY utt),
{out}_t AS (SELECT utt, unnest(range(0, n // {hop} + 1)) AS t FROM {out}_n WHERE n >= {rate * 0.1!r}),
{out}_k AS (SELECT unnest(range(0, {n_fft})) AS k), {out}_b AS (SELECT unnest(range(0, {half + 1})) AS b),
{out}_x AS (SELECT f.utt, f.t, b.b, sum(s.v * {hann} * cos({turn})) AS re, sum(s.v * {hann} * sin({turn})) AS im
  FROM {out}_t f, {out}_k k, {out}_b b JOIN {source} s ON s.utt = f.utt AND s.i = f.t * {hop} - {half} + k.k GROUP BY f.utt, f.t, b.b),
{out}_q AS (SELECT utt, b, avg(re * re + im * im) AS q FROM {out}_x JOIN {out}_n USING (utt) WHERE t * {hop} < e OR t = 0 GROUP BY utt, b),
{out}_g AS (SELECT utt, t, b, re, im, CASE WHEN re * re + im * im > 0 THEN sqrt(greatest(re * re + im * im - {share!r} * q, 0) / (re * re + im * im)) ELSE 0 END
  * CASE WHEN b IN (0, {half}) THEN 1 ELSE 2 END / {n_fft} AS g FROM {out}_x JOIN {out}_q USING (utt, b)),
{out}_y AS (SELECT b.utt, b.t * {hop} - {half} + k.k AS i, {hann} * sum(g * (re * cos({turn}) + im * sin({turn}))) AS y, {hann} ** 2 AS w
  FROM {out}_g b, {out}_k k GROUP BY b.utt, b.t, k.k),
{out}_a AS (SELECT utt, i, sum(y) AS y, sum(w) AS w FROM {out}_y GROUP BY utt, i),
{out} AS (SELECT s.utt, s.i, CASE WHEN a.w > 1e-10 THEN a.y / a.w ELSE s.v END AS v, a.utt IS NOT NULL AS reduced FROM {source} s LEFT JOIN {out}_a a ON a.utt = s.utt AND a.i = s.i)"""


# A rate at which some series are under a tenth of a second.
REDUCE_RATE = 600.0


@query("noise_reduce", f"""WITH {B.SIGNAL_SQL}, sound AS (SELECT utt, frame_idx AS i, value / 7 AS v FROM signal), {noise_reduce_sql('sound', 'quiet', REDUCE_RATE, N_FFT, HOP)}
  SELECT utt, CAST(i AS BIGINT) AS frame_idx, {d6('v')} AS value, reduced FROM quiet""")
def noise_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audio.noise_reduce(sound(spark, sf_dir), UTT, "frame_idx", "value", REDUCE_RATE, 0.8, N_FFT, HOP), "value")


@query("analytic_magnitude", f"WITH {SERIES_SQL}, {hilbert_sql('series', 'm')} SELECT utt, CAST(i AS BIGINT) AS frame_idx, {d6('v')} AS magnitude FROM m")
def analytic_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(hilbert.magnitude(B.samples(spark, sf_dir), UTT, "frame_idx", "value"), "magnitude")


@query("audio_envelope", f"""WITH {SERIES_SQL}, {hilbert_sql('series', 'm')}, {smooth_sql('m', 's', SMOOTH)}, {minmax_sql('s', 'e')}
  SELECT utt, CAST(i AS BIGINT) AS frame_idx, {d6('v')} AS envelope FROM e""")
def audio_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(jobs.audio_envelope(B.samples(spark, sf_dir), UTT, "frame_idx", "value", SMOOTH_MS, SMOOTH_RATE), "envelope")
