"""Queries that run the batch jobs and the streaming report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalgrid import fixed
from vocalgrid.functions import kernels
from vocalgrid.operators import frames, jobs, ordering, segmentation, series, summaries
from vocalgrid.plans import binding as B
from vocalgrid.plans.catalog import d6, query
from vocalgrid.plans.mask_queries import (
    GEOMETRY_SQL, PSEUDO_BINS, PSEUDO_OTSU_SQL, PSEUDO_SQL, S, geometry_columns_sql, mask_pixels, rounded,
)
from vocalgrid.plans.signal_queries import hilbert_sql, interpolate_sql, minmax_sql, noise_reduce_sql, smooth_sql, zscore_sql
from vocalgrid.plans.table_queries import (
    FEATURES_SQL,
    MISMATCH_SQL,
    SUBJECT_SPLIT_SQL,
    order_features,
    split_utterances,
)
from vocalgrid.session import new_location
from vocalgrid.sources import stores
from vocalgrid.streaming.progress import run_progress

UTT = ["utt"]
AUDIO_FPS, AUDIO_RATE, SMOOTH_MS = 10.0, 13.0, 50.0


# Alignment: label n's frames are the images of user n's samples -----------------------------------


def align_sql(pixels: str, heard: str = "") -> str:
    """aligned: offset and correlation per utterance, from a table (utt, frame_idx, y, x, v); ``heard`` makes heard from heard0."""
    frame_weights = series.gaussian_weights(SMOOTH_MS / 1000 * AUDIO_FPS)
    sample_weights = series.gaussian_weights(SMOOTH_MS / 1000 * AUDIO_RATE)
    return f"""diff AS (SELECT utt, frame_idx AS i, abs(v - lag(v) OVER (PARTITION BY utt, y, x ORDER BY frame_idx)) AS d FROM {pixels}),
moved AS (SELECT utt, i, coalesce(sum(d), 0) AS v FROM diff GROUP BY utt, i),
{smooth_sql('moved', 'moved_s', frame_weights)}, {minmax_sql('moved_s', 'energy0')},
energy AS (SELECT utt, i, i / {AUDIO_FPS!r}::DOUBLE AS t, v FROM energy0),
{B.SIGNAL_SQL}, {"heard0" if heard else "heard"} AS (SELECT utt, frame_idx AS i, value AS v FROM signal WHERE utt IN (SELECT utt FROM energy)),
{heard + "," if heard else ""}
lens AS (SELECT utt, f.n AS n_frames, a.n AS n_samples, CAST(ceil(greatest(f.n / {AUDIO_FPS!r}::DOUBLE, a.n / {AUDIO_RATE!r}::DOUBLE) * {AUDIO_RATE!r}::DOUBLE) AS BIGINT) AS m
  FROM (SELECT utt, count(*) AS n FROM energy GROUP BY utt) f JOIN (SELECT utt, count(*) AS n FROM heard GROUP BY utt) a USING (utt)),
{interpolate_sql('energy', 'clocked', 'lens', AUDIO_RATE, 'zero')}, {zscore_sql('clocked', 'zm')},
{hilbert_sql('heard', 'mag')}, {smooth_sql('mag', 'mag_s', sample_weights)}, {minmax_sql('mag_s', 'env')}, {zscore_sql('env', 'za')},
pad AS (SELECT coalesce(zm.utt, za.utt) AS utt, coalesce(zm.i, za.i) AS i, coalesce(zm.v, 0) AS m, coalesce(za.v, 0) AS a
  FROM zm FULL JOIN za ON zm.utt = za.utt AND zm.i = za.i),
padn AS (SELECT utt, count(*) AS n FROM pad GROUP BY utt),
lags AS (SELECT utt, n, unnest(range(-(n // 2), n - n // 2)) AS lag FROM padn),
cc AS (SELECT l.utt, l.n, l.lag, sum(coalesce(q.a, 0) * p.m) AS total FROM lags l JOIN pad p ON p.utt = l.utt
  LEFT JOIN pad q ON q.utt = p.utt AND q.i = p.i + l.lag GROUP BY l.utt, l.n, l.lag),
aligned AS (SELECT utt, lag AS offset_samples, lag / {AUDIO_RATE!r}::DOUBLE AS offset_seconds, total / n AS correlation, n_frames, n_samples
  FROM (SELECT *, row_number() OVER (PARTITION BY utt ORDER BY total DESC, lag) AS r FROM cc) JOIN lens USING (utt) WHERE r = 1)"""


def images_and_audio(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    images = B.indexed_frames(spark, sf_dir).select("utt", "frame_idx", "pixels")
    return images, B.samples(spark, sf_dir)


@query("align", f"""WITH {B.PIXELS_SQL}, {align_sql('px')}
  SELECT utt, n_frames, n_samples, CAST(offset_samples AS BIGINT) AS offset_samples, {d6('offset_seconds')} AS offset_seconds, {d6('correlation')} AS correlation FROM aligned""")
def align(spark: SparkSession, sf_dir: str) -> DataFrame:
    images, audio = images_and_audio(spark, sf_dir)
    out = jobs.align(images, audio, UTT, "frame_idx", "pixels", "value", AUDIO_FPS, AUDIO_RATE, SMOOTH_MS)
    return rounded(out, ["offset_seconds", "correlation"])


@query("aligned_audio", f"""WITH {B.PIXELS_SQL}, {align_sql('px')},
  plan AS (SELECT utt, offset_samples AS o, CAST(floor(n_frames / {AUDIO_FPS!r}::DOUBLE * {AUDIO_RATE!r}::DOUBLE) AS BIGINT) AS len FROM aligned),
  g AS (SELECT utt, o, unnest(range(0, len)) AS i FROM plan)
  SELECT g.utt, CAST(g.i AS BIGINT) AS frame_idx, coalesce(h.v, 0) AS value FROM g LEFT JOIN heard h ON h.utt = g.utt AND h.i = g.i + g.o""")
def aligned_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    images, audio = images_and_audio(spark, sf_dir)
    found = jobs.align(images, audio, UTT, "frame_idx", "pixels", "value", AUDIO_FPS, AUDIO_RATE, SMOOTH_MS)
    return jobs.aligned_audio(audio, found, UTT, "frame_idx", "value", AUDIO_FPS, AUDIO_RATE)


def _blur_sql() -> str:
    from vocalgrid.plans.frame_queries import _weights_sql, mirrored

    return f"""{_weights_sql('g', kernels.gaussian(3, 1.0))},
across AS (SELECT p.utt, p.frame_idx, p.y, p.x, sum(g.w * q.v) AS v FROM px p, g JOIN px q
  ON q.frame_id = p.frame_id AND q.y = p.y AND q.x = {mirrored('p.x + g.k', S)} GROUP BY ALL),
blurred AS (SELECT p.utt, p.frame_idx, p.y, p.x, sum(g.w * q.v) AS v FROM across p, g JOIN across q
  ON q.utt = p.utt AND q.frame_idx = p.frame_idx AND q.x = p.x AND q.y = {mirrored('p.y + g.k', S)} GROUP BY ALL),
near AS (SELECT utt, frame_idx, y, x, v, coalesce(lag(v) OVER w, v) AS a, coalesce(lead(v) OVER w, v) AS b, count(*) OVER (PARTITION BY utt, y, x) AS n
  FROM blurred WINDOW w AS (PARTITION BY utt, y, x ORDER BY frame_idx)),
clean AS (SELECT utt, frame_idx, y, x, CASE WHEN n < 3 THEN v ELSE list_sort([a, v, b])[2] END AS v FROM near)"""


@query("preprocess_job", f"""WITH {B.PIXELS_SQL}, {_blur_sql()}, {align_sql('clean')},
  judged AS (SELECT *, n_frames / 83.28::DOUBLE * 0.5 AS half FROM aligned),
  every AS (SELECT utt, count(DISTINCT frame_idx) AS n FROM px GROUP BY utt)
  SELECT e.utt, j.n_frames, j.n_samples, CAST(offset_samples AS BIGINT) AS offset_samples, {d6('offset_seconds')} AS offset_seconds, {d6('correlation')} AS correlation,
    correlation >= 0.3 AND abs(offset_seconds) <= half AS is_valid,
    CASE WHEN correlation < 0.3 THEN 'Low correlation: ' || printf('%.3f', correlation) || ' < 0.3'
      WHEN abs(offset_seconds) > half THEN 'Large offset: ' || printf('%.2f', abs(offset_seconds)) || 's (>' || printf('%.2f', half) || 's)'
      WHEN correlation IS NOT NULL THEN 'Valid alignment: correlation=' || printf('%.3f', correlation) END AS message,
    CASE WHEN correlation IS NOT NULL THEN {B.TIER_SQL} END AS tier, CASE WHEN correlation IS NULL THEN 'no audio' END AS error
  FROM every e LEFT JOIN judged j USING (utt)""")
def preprocess_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    images, audio = images_and_audio(spark, sf_dir)
    out = jobs.preprocess(images, audio, UTT, "frame_idx", "pixels", "value", S, S, AUDIO_FPS, AUDIO_RATE, SMOOTH_MS)
    return rounded(out, ["offset_seconds", "correlation"])


STORE_FFT, STORE_HOP = 8, 2
STORE_SQL = f"""{B.PIXELS_SQL}, {_blur_sql()}, {align_sql('clean', noise_reduce_sql('heard0', 'heard', AUDIO_RATE, STORE_FFT, STORE_HOP, fixed.NOISE_SHARE))},
  every AS (SELECT utt, count(DISTINCT frame_idx) AS n FROM px GROUP BY utt),
  kept AS (SELECT utt, count(*) AS n_pixels, sum(v) AS pixel_sum FROM clean WHERE utt IN (SELECT utt FROM aligned) GROUP BY utt),
  plan AS (SELECT utt, offset_samples AS o, CAST(floor(n_frames / {AUDIO_FPS!r}::DOUBLE * {AUDIO_RATE!r}::DOUBLE) AS BIGINT) AS len FROM aligned),
  slots AS (SELECT utt, o, unnest(range(0, len)) AS i FROM plan),
  said AS (SELECT s.utt, count(*) AS n_audio, sum(coalesce(h.v, 0) * (s.i + 1)) AS audio_sum FROM slots s LEFT JOIN heard h ON h.utt = s.utt AND h.i = s.i + s.o GROUP BY s.utt)"""


def _stored_job(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    images, audio = images_and_audio(spark, sf_dir)
    place = new_location(spark, "preprocessed")
    subject = F.floor(F.col("utt") / 4).cast("long")
    manifest = jobs.preprocess_store(
        images, audio, place, subject, UTT, "frame_idx", "pixels", "value", S, S, AUDIO_FPS, AUDIO_RATE, SMOOTH_MS, n_fft=STORE_FFT, hop=STORE_HOP
    )
    return manifest, place


@query("preprocess_store", f"""WITH {STORE_SQL}
  SELECT e.utt, CAST(offset_samples AS BIGINT) AS offset_samples, {d6('correlation')} AS correlation, CASE WHEN a.utt IS NULL THEN 'no audio' END AS error,
    CAST(n_pixels AS BIGINT) AS n_pixels, {d6('pixel_sum')} AS pixel_sum, CAST(n_audio AS BIGINT) AS n_audio, {d6('audio_sum')} AS audio_sum
  FROM every e LEFT JOIN aligned a USING (utt) LEFT JOIN kept USING (utt) LEFT JOIN said USING (utt)""")
def preprocess_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored job: its manifest beside sums over the frames and the aligned audio read back from the store."""
    manifest, place = _stored_job(spark, sf_dir)
    frames_kept, said = (jobs.stored(manifest, place, what, UTT) for what in ("frames", "aligned_audio"))
    pixels = frames_kept.groupBy("utt").agg(F.sum(F.size("pixels")).alias("n_pixels"), F.sum(F.aggregate("pixels", F.lit(0.0), lambda a, v: a + v)).alias("pixel_sum"))
    weighted = F.aggregate(F.transform("value", lambda v, i: v * (F.col("start") + i + 1)), F.lit(0.0), lambda a, v: a + v)
    sounds = said.groupBy("utt").agg(F.sum(F.size("value")).alias("n_audio"), F.sum(weighted).alias("audio_sum"))
    out = manifest.select("utt", "offset_samples", "correlation", "error").join(pixels, "utt", "left").join(sounds, "utt", "left")
    return rounded(out, ["correlation", "pixel_sum", "audio_sum"])


@query("batch_summary", f"""WITH {STORE_SQL}, judged AS (SELECT e.utt // 4 AS subject, a.utt IS NOT NULL AS ok FROM every e LEFT JOIN aligned a USING (utt))
  SELECT CAST(subject AS BIGINT) AS subject, grouping_id(subject) AS level, count(*) AS total, count(*) FILTER (ok) AS processed, count(*) FILTER (NOT ok) AS failed,
    {d6('count(*) FILTER (ok) / count(*)')} AS success_rate FROM judged GROUP BY ROLLUP (subject)""")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup of what the stored job's manifest says."""
    return rounded(jobs.batch_summary(_stored_job(spark, sf_dir)[0]), ["success_rate"])


@query("kernel_faults", f"""WITH {B.PIXELS_SQL}, {_blur_sql()}, {align_sql('clean')},
  every AS (SELECT utt, count(DISTINCT frame_idx) AS n, max(v) > 0.37 AS loud FROM px GROUP BY utt)
  SELECT e.utt, CASE WHEN NOT loud THEN CAST(offset_samples AS BIGINT) END AS offset_samples, CASE WHEN NOT loud THEN {d6('correlation')} END AS correlation,
    CASE WHEN j.utt IS NULL THEN 'no audio' WHEN loud THEN 'frames: ValueError: too bright' END AS error FROM every e LEFT JOIN aligned j USING (utt)""")
def kernel_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job with a kernel that fails on bright frames: their utterances are reported, the others are unchanged."""
    images, audio = images_and_audio(spark, sf_dir)
    blur = frames.blur_kernel(S, S, 1.0)

    def strict(rows):
        if (rows > 0.37).any():
            raise ValueError("too bright")
        return blur(rows)

    out = jobs.preprocess(images, audio, UTT, "frame_idx", "pixels", "value", S, S, AUDIO_FPS, AUDIO_RATE, SMOOTH_MS, blur=strict)
    return rounded(out.select("utt", "offset_samples", "correlation", "error"), ["correlation"])


FAULTY_SQL = "utt % 5 IN (1, 2, 3)"


@query("preprocess_faults", f"""WITH {B.PIXELS_SQL}, {_blur_sql()}, {align_sql('clean')},
  every AS (SELECT utt, count(DISTINCT frame_idx) AS n FROM px GROUP BY utt)
  SELECT e.utt, CASE WHEN NOT {FAULTY_SQL} THEN CAST(offset_samples AS BIGINT) END AS offset_samples,
    CASE WHEN NOT {FAULTY_SQL} THEN {d6('correlation')} END AS correlation,
    CASE WHEN NOT {FAULTY_SQL} AND correlation IS NOT NULL THEN {B.TIER_SQL} END AS tier,
    CASE WHEN correlation IS NULL THEN 'no audio' WHEN {FAULTY_SQL} THEN 'frames not usable' END AS error
  FROM every e LEFT JOIN aligned j USING (utt)""")
def preprocess_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job with a null frame, a NaN pixel or a frame of another size in some utterances; the others are unchanged."""
    images, audio = images_and_audio(spark, sf_dir)
    kind, hit = F.pmod("utt", F.lit(5)), F.col("frame_idx") == 3
    pixels = (
        F.when(hit & (kind == 1), F.lit(None).cast("array<double>"))
        .when(hit & (kind == 2), F.transform("pixels", lambda v, i: F.when(i == 7, float("nan")).otherwise(v)))
        .when(hit & (kind == 3), F.slice("pixels", 1, S * S - 1))
        .otherwise(F.col("pixels"))
    )
    out = jobs.preprocess(images.withColumn("pixels", pixels), audio, UTT, "frame_idx", "pixels", "value", S, S, AUDIO_FPS, AUDIO_RATE, SMOOTH_MS)
    return rounded(out.select("utt", "offset_samples", "correlation", "tier", "error"), ["correlation"])


@query("failure_ledger", """WITH s AS (SELECT user_id AS utt, count(*) AS n, bool_or(event_id % 997 = 0) AS bad,
    min(try_cast(json_extract_string(props, '$.k') AS BIGINT)) AS k FROM events GROUP BY user_id)
  SELECT utt, n, CASE WHEN n < 60 THEN 'too short' WHEN bad THEN 'not finite' WHEN k IS NULL OR k > 2 THEN 'bad metadata' END AS error FROM s""")
def failure_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("long")
    events = B.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("utt")).agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.col("event_id") % 997 == 0).alias("bad"), F.min(k).alias("k")
    )
    checks = {
        "too short": F.col("n") < 60,
        "not finite": F.col("bad"),
        "bad metadata": F.col("k").isNull() | (F.col("k") > 2),
    }
    return jobs.failure_ledger(events, checks).select("utt", "n", "error")


@query("parameter_job", f"""WITH {GEOMETRY_SQL}, m AS (SELECT y, x, avg(cls) AS v FROM mask GROUP BY y, x),
  e AS (SELECT utt, frame_id, {d6('sum((cls - v) * (cls - v))')} AS pca_energy FROM mask JOIN m USING (y, x) GROUP BY utt, frame_id)
  SELECT utt, frame_id, {geometry_columns_sql()}, CAST({S * S} AS BIGINT) AS n_components, pca_energy FROM geo JOIN e USING (utt, frame_id)""")
def parameter_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both kinds, stored by kind and read back; all components, so that their squares can be checked against the masks."""
    geometric, scored = _stored_parameters(spark, sf_dir)
    energy = F.aggregate("pca", F.lit(0.0), lambda a, v: a + v * v)
    components = scored.select("utt", "frame_id", F.size("pca").cast("long").alias("n_components"), energy.alias("pca_energy"))
    joined = geometric.join(components, ["utt", "frame_id"]).withColumn("utt", F.col("utt").cast("long"))
    return rounded(joined, [*fixed.GEOMETRIC_FEATURES, "pca_energy"])


@query("parameter_stats", f"""WITH f AS (SELECT CAST(label AS BIGINT) AS utt, count(*) AS n FROM embeddings GROUP BY label), kinds AS (
    SELECT * FROM (VALUES ('geometric', CAST({len(fixed.GEOMETRIC_FEATURES)} AS BIGINT)), ('pca', CAST({S * S} AS BIGINT))) k(kind, n_params))
  SELECT kind, utt, CAST(count(*) AS BIGINT) AS n_utterances, CAST(sum(n) AS BIGINT) AS n_frames, max(n_params) AS n_params FROM f, kinds GROUP BY GROUPING SETS ((kind, utt), (kind))""")
def parameter_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the parameter job stored, per utterance and in total."""
    geometric, scored = _stored_parameters(spark, sf_dir)
    sizes = {"geometric": (geometric, F.lit(len(fixed.GEOMETRIC_FEATURES))), "pca": (scored, F.size("pca"))}
    parts = [
        summaries.extraction_stats(df.withColumn("utt", F.col("utt").cast("long")), "utt", width).withColumn("kind", F.lit(kind))
        for kind, (df, width) in sizes.items()
    ]
    return parts[0].unionByName(parts[1])


def _stored_parameters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    both = jobs.parameters(B.masks(spark, sf_dir), ["utt", "frame_id"], "mask", S, S, "both", S * S)
    where = new_location(spark, "parameters")
    stores.write_features(both.drop("pca"), where, "geometric", "utt", ["frame_id"])
    stores.write_features(both.select("utt", "frame_id", "pca"), where, "pca", "utt", ["frame_id"])
    return stores.read_features(spark, where, "geometric"), stores.read_features(spark, where, "pca")


@query("training_table_job", f"""WITH {FEATURES_SQL}, {B.PARAMETERS_SQL}, {MISMATCH_SQL}, {SUBJECT_SPLIT_SQL},
  t AS (SELECT utt, frame_idx, feature, l_quantity, l_extendedprice, split, count(*) OVER (PARTITION BY utt) AS n
    FROM features JOIN parameters USING (utt, frame_idx) JOIN orders ON o_orderkey = utt JOIN splits ON subject = o_custkey
    WHERE utt NOT IN (SELECT utt FROM mismatch)),
  st AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_extendedprice) AS mp, stddev_pop(l_extendedprice) AS sp FROM t WHERE split = 'train')
  SELECT utt, CAST(frame_idx AS BIGINT) AS frame_idx, split, {d6('feature')} AS feature, {d6('(l_quantity - mq) / sq')} AS l_quantity_z,
    {d6('(l_extendedprice - mp) / sp')} AS l_extendedprice_z, utt || '_seq' || (frame_idx // 2) AS sequence
  FROM t, st WHERE frame_idx // 2 < n // 2""")
def training_table_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = B.parameters(spark, sf_dir).select("utt", "frame_idx", "l_quantity", "l_extendedprice")
    utts = split_utterances(spark, sf_dir)
    out = jobs.training_table(
        order_features(spark, sf_dir), params, utts, ["l_quantity", "l_extendedprice"], length=2
    )
    kept = out.select("utt", "frame_idx", "split", "feature", "l_quantity_z", "l_extendedprice_z", "sequence")
    return rounded(kept, ["feature", "l_quantity_z", "l_extendedprice_z"])


@query("training_table_faults", f"""WITH {FEATURES_SQL}, {B.PARAMETERS_SQL}, f AS (SELECT utt, count(*) AS n FROM features GROUP BY utt), p AS (SELECT utt, count(*) AS n FROM parameters GROUP BY utt)
  SELECT coalesce(f.utt, p.utt) AS utt, coalesce(f.n, 0) AS n_features, coalesce(p.n, 0) AS n_params, CASE WHEN f.n IS NULL THEN 'no features' WHEN p.n IS NULL THEN 'no parameters'
    WHEN f.n <> p.n THEN 'frame counts differ: ' || f.n || ' features, ' || p.n || ' parameters' ELSE 'no split' END AS error
  FROM f FULL JOIN p ON f.utt = p.utt WHERE f.n IS DISTINCT FROM p.n OR coalesce(f.utt, p.utt) NOT IN (SELECT o_orderkey FROM orders)""")
def training_table_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every utterance that the training table leaves out, with the reason."""
    params = B.parameters(spark, sf_dir).select("utt", "frame_idx", "l_quantity", "l_extendedprice")
    return jobs.training_tables(order_features(spark, sf_dir), params, split_utterances(spark, sf_dir), ["l_quantity", "l_extendedprice"], length=2)[1]


# Pseudo labels: ten frames of each subject's best utterance -----------------------------------------


@query("pseudo_label_job", f"""WITH {PSEUDO_SQL}
  SELECT utt, frame_id, sample, {d6('threshold')} AS threshold, y, x, CAST(label AS BIGINT) AS label FROM pseudo""")
def pseudo_label_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = segmentation.pseudo_labels(_pseudo_frames(spark, sf_dir), "pixels", S, S, "combined")
    return rounded(mask_pixels(labelled, "label", ["utt", "frame_id", "sample", "threshold"]), ["threshold"])


@query("pseudo_label_counts", f"""WITH {PSEUDO_SQL}
  SELECT utt, sample, CAST(label AS BIGINT) AS class, count(*) AS pixels FROM pseudo GROUP BY ALL""")
def pseudo_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = segmentation.pseudo_labels(_pseudo_frames(spark, sf_dir), "pixels", S, S, "combined")
    return segmentation.label_counts(labelled, ["utt", "sample"], "label", 5)


@query("pseudo_label_otsu", f"""WITH {PSEUDO_OTSU_SQL}
  SELECT utt, sample, CAST((v >= t1)::INT + (v >= t2)::INT AS BIGINT) AS class, count(*) AS pixels FROM picked JOIN thr USING (frame_id) GROUP BY ALL""")
def pseudo_label_otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = segmentation.pseudo_labels(_pseudo_frames(spark, sf_dir), "pixels", S, S, "otsu", bins=PSEUDO_BINS)
    return segmentation.label_counts(labelled, ["utt", "sample"], "label", 3)


def _pseudo_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = B.indexed_frames(spark, sf_dir)
    utts = df.groupBy("utt").agg(F.count(F.lit(1)).alias("n"), F.avg(F.get("pixels", 0)).alias("correlation"))
    utts = utts.withColumn("subject", F.floor(F.col("utt") / 2).cast("long"))
    best = ordering.best_per_subject(utts, "subject", "utt", "correlation")
    picks = series.linspace_positions(best, "n", 10).select("utt", "frame_idx", F.col("sample").cast("long").alias("sample"))
    return picks.join(df, ["utt", "frame_idx"])


# Logs and streams -------------------------------------------------------------------------------


@query("metrics_csv", f"""WITH l AS (SELECT CAST(c_custkey AS INTEGER) AS step, CAST(c_nationkey AS INTEGER) AS epoch, c_acctbal / 1e4 AS v, c_custkey % 2 = 0 AS is_train FROM customer)
  SELECT epoch, 'train/loss' AS metric, {d6('v')} AS value FROM l WHERE is_train UNION ALL SELECT epoch, 'val/loss', {d6('v')} FROM l WHERE NOT is_train""")
def metrics_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse log written as CSV, read with its declared schema and unpivoted."""
    from vocalgrid.operators.selection import notna_series

    value = F.col("c_acctbal") / 1e4
    even = F.col("c_custkey") % 2 == 0
    none = F.lit(None).cast("double")
    log = B.table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("int").alias("epoch"), none.alias("lr-AdamW"), F.col("c_custkey").cast("int").alias("step"),
        none.alias("train/acc"), none.alias("train/dice"), none.alias("train/iou"), F.when(even, value).alias("train/loss"),
        none.alias("val/acc"), none.alias("val/dice"), none.alias("val/iou"), F.when(~even, value).alias("val/loss"),
    )
    where = new_location(spark, "metrics")
    stores.write_metrics(log, where)
    back = stores.read_metrics(spark, where)
    return rounded(notna_series(back, "epoch", ["train/loss", "val/loss"]), ["value"])


@query("progress_stream", f"""WITH w AS (SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS d, count(*) AS expected, count(*) FILTER (event_type <> 'error') AS done FROM events GROUP BY 1)
  SELECT strftime(d, '%Y-%m-%d') AS day, expected, done, {d6('done / expected * 100')} AS percent, {d6('(expected - done) * 3.5::DOUBLE / 60')} AS eta_minutes FROM w""")
def progress_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = B.table(spark, sf_dir, "events").schema
    # A pattern, as a stream takes a plain path for a folder only, and the table may be one file or a folder of parts.
    out = run_progress(
        spark, f"{sf_dir}/[e]vents.parquet", schema, "ts", "1 day", (F.col("event_type") != "error").cast("long"), F.lit(1),
    )
    named = out.withColumn("day", F.date_format("window_start", "yyyy-MM-dd")).drop("window_start")
    return rounded(named, ["percent", "eta_minutes"])
