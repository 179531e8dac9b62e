"""Queries on frames and their pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalgrid import scale
from vocalgrid.functions import columns as C
from vocalgrid.functions import kernels
from vocalgrid.operators import frames, selection, series, summaries
from vocalgrid.plans import binding as B
from vocalgrid.plans.catalog import d6, query
from vocalgrid.session import new_location
from vocalgrid.sources import stores

S, P = B.SIDE, B.PIXELS
KEY = ["utt", "frame_id"]


def as_pixels(df: DataFrame, column: str = "pixels", width: int = S, keys: list[str] = KEY) -> DataFrame:
    """Pixel rows with the compared precision."""
    return frames.pixel_rows(df, keys, column, width).withColumn("value", C.r6(F.col("value")))


@query("frame_slice", f"WITH {B.FRAMES_SQL} SELECT utt, frame_id, CAST(frame_idx AS BIGINT) AS frame_idx FROM frames WHERE frame_idx >= 5 AND frame_idx < 20")
def frame_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.frame_slice(B.indexed_frames(spark, sf_dir), "frame_idx", 5, 20).select("utt", "frame_id", "frame_idx")


@query("roi_crop", f"""WITH {B.PIXELS_SQL} SELECT utt, frame_id, y - 2 AS y, x - 1 AS x, {d6('v')} AS value FROM px WHERE y >= 2 AND y < 7 AND x >= 1 AND x < 5""")
def roi_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = B.frames(spark, sf_dir).withColumn("pixels", C.crop(F.col("pixels"), S, 2, 7, 1, 5))
    return as_pixels(cut, width=4)


@query("normalize_array", f"""WITH {B.PIXELS_SQL}, e AS (SELECT frame_id, min(v) AS lo, max(v) AS hi FROM px GROUP BY frame_id)
  SELECT utt, frame_id, y, x, {d6('CASE WHEN lo = hi THEN 0 ELSE (v - lo) / (hi - lo) * 2 - 1 END')} AS value FROM px JOIN e USING (frame_id)""")
def normalize_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_pixels(B.frames(spark, sf_dir).withColumn("pixels", C.normalize_array(F.col("pixels"), -1.0, 1.0)))


@query("frame_zscore", f"""WITH {B.PIXELS_SQL}, e AS (SELECT frame_id, avg(v) AS m, stddev_pop(v) AS s FROM px GROUP BY frame_id)
  SELECT utt, frame_id, y, x, {d6('(v - m) / (s + 1e-8)')} AS value FROM px JOIN e USING (frame_id)""")
def frame_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_pixels(B.frames(spark, sf_dir).withColumn("pixels", C.frame_zscore(F.col("pixels"))))


PADDED = 13


@query("pad_frame", f"""WITH {B.PIXELS_SQL}, cells AS (SELECT utt, frame_id, i // {PADDED} AS y, i % {PADDED} AS x
    FROM (SELECT utt, frame_id, unnest(range(0, {PADDED * PADDED})) AS i FROM frames))
  SELECT c.utt, c.frame_id, c.y, c.x, {d6('coalesce(v, 0)')} AS value
  FROM cells c LEFT JOIN px ON px.frame_id = c.frame_id AND px.y = c.y - 2 AND px.x = c.x - 2""")
def pad_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = B.frames(spark, sf_dir).withColumn("pixels", C.pad_frame(F.col("pixels"), S, S, PADDED))
    return as_pixels(padded, width=PADDED)


@query("unpad_mask", f"""WITH {B.MASK_SQL} SELECT utt, frame_id, y - 1 AS y, x - 1 AS x, {d6('cls')} AS value FROM mask
  WHERE y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6""")
def unpad_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = B.masks(spark, sf_dir).withColumn("mask", C.unpad_frame(F.col("mask"), S, 6))
    return as_pixels(cut, "mask", width=6)


@query("clip01", f"WITH {B.PIXELS_SQL} SELECT utt, frame_id, y, x, {d6('greatest(0, least(1, v * 4))')} AS value FROM px")
def clip01(spark: SparkSession, sf_dir: str) -> DataFrame:
    clipped = F.transform("pixels", lambda v: C.clip01(v * 4))
    return as_pixels(B.frames(spark, sf_dir).withColumn("pixels", clipped))


@query("digitize", f"WITH {B.MASK_SQL} SELECT utt, frame_id, y, x, CAST(cls AS BIGINT) AS cls FROM mask")
def digitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames.pixel_rows(B.masks(spark, sf_dir), KEY, "mask", S, "cls")
    return rows.withColumn("cls", F.col("cls").cast("long"))


@query("motion_energy_l1", f"""WITH {B.PIXELS_SQL}, d AS (SELECT utt, frame_idx, abs(v - lag(v) OVER (PARTITION BY utt, y, x ORDER BY frame_idx)) AS d
    FROM px WHERE y >= 1 AND y < 7 AND x >= 2 AND x < 8)
  SELECT utt, CAST(frame_idx AS BIGINT) AS frame_idx, {d6('coalesce(sum(d), 0)')} AS energy FROM d GROUP BY utt, frame_idx""")
def motion_energy_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frames.motion_energy(B.indexed_frames(spark, sf_dir), ["utt"], "frame_idx", "pixels", "l1", S, (1, 7, 2, 8))
    return out.withColumn("energy", C.r6(F.col("energy")))


@query("motion_energy_rms", f"""WITH {B.PIXELS_SQL}, d AS (SELECT utt, frame_idx, v - lag(v) OVER (PARTITION BY utt, y, x ORDER BY frame_idx) AS d FROM px)
  SELECT utt, CAST(frame_idx AS BIGINT) AS frame_idx, {d6('sqrt(avg(d * d))')} AS energy FROM d WHERE frame_idx > 0 GROUP BY utt, frame_idx""")
def motion_energy_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frames.motion_energy(B.indexed_frames(spark, sf_dir), ["utt"], "frame_idx", "pixels", "rms")
    return out.withColumn("energy", C.r6(F.col("energy")))


@query("motion_energy_mixed", f"""WITH {B.PIXELS_SQL}, kept AS (SELECT * FROM px WHERE utt % 3 <> 0 OR y < 4),
  d AS (SELECT utt, frame_idx, v - lag(v) OVER (PARTITION BY utt, y, x ORDER BY frame_idx) AS d FROM kept)
  SELECT utt, CAST(frame_idx AS BIGINT) AS frame_idx, {d6('sqrt(avg(d * d))')} AS energy FROM d WHERE frame_idx > 0 GROUP BY utt, frame_idx""")
def motion_energy_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of two sizes in one table: every third utterance holds the upper half only."""
    half = F.when(F.col("utt") % 3 == 0, F.slice("pixels", 1, B.PIXELS // 2)).otherwise(F.col("pixels"))
    out = frames.motion_energy(B.indexed_frames(spark, sf_dir).withColumn("pixels", half), ["utt"], "frame_idx", "pixels", "rms")
    return out.withColumn("energy", C.r6(F.col("energy")))


@query("temporal_median", f"""WITH {B.PIXELS_SQL}, near AS (SELECT utt, frame_idx, y, x, v,
    coalesce(lag(v) OVER w, v) AS a, coalesce(lead(v) OVER w, v) AS b, count(*) OVER (PARTITION BY utt, y, x) AS n
    FROM px WINDOW w AS (PARTITION BY utt, y, x ORDER BY frame_idx))
  SELECT utt, CAST(frame_idx AS BIGINT) AS frame_idx, y, x, {d6('CASE WHEN n < 3 THEN v ELSE list_sort([a, v, b])[2] END')} AS value FROM near""")
def temporal_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frames.temporal_median(B.indexed_frames(spark, sf_dir), ["utt"], "frame_idx", "pixels", 3)
    return as_pixels(out, keys=["utt", "frame_idx"])


def _weights_sql(name: str, weights) -> str:
    half = len(weights) // 2
    rows = ", ".join(f"({i - half}, {float(w)!r}::DOUBLE)" for i, w in enumerate(weights))
    return f"{name}(k, w) AS (VALUES {rows})"


def mirrored(place: str, size: int) -> str:
    """SQL: index folded at the ends without repeating the edge."""
    period = 2 * (size - 1)
    turn = f"((({place}) % {period} + {period}) % {period})"
    return f"CASE WHEN {turn} < {size} THEN {turn} ELSE {period} - {turn} END"


@query("spatial_gaussian", f"""WITH {B.PIXELS_SQL}, {_weights_sql('g', kernels.gaussian(3, 1.0))},
  across AS (SELECT p.utt, p.frame_id, p.y, p.x, sum(g.w * q.v) AS v FROM px p, g JOIN px q
    ON q.frame_id = p.frame_id AND q.y = p.y AND q.x = {mirrored('p.x + g.k', S)} GROUP BY ALL)
  SELECT p.utt, p.frame_id, p.y, p.x, {d6('sum(g.w * q.v)')} AS value FROM across p, g JOIN across q
    ON q.frame_id = p.frame_id AND q.x = p.x AND q.y = {mirrored('p.y + g.k', S)} GROUP BY p.utt, p.frame_id, p.y, p.x""")
def spatial_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    blur = frames.spatial_gaussian(S, S, 1.0)
    return as_pixels(B.frames(spark, sf_dir).withColumn("pixels", blur(F.col("pixels"))))


def _shares(out: DataFrame) -> DataFrame:
    return out.select(*[C.r6(F.col(c)).alias(c) if c.startswith("share") else F.col(c) for c in out.columns])


SHARES_SQL = ", ".join(f"avg(CASE WHEN cls = {c} THEN 1 ELSE 0 END) AS share_{c}" for c in range(4))


@query("class_distribution", f"""WITH {B.MASK_SQL}, s AS (SELECT utt, frame_id, {SHARES_SQL}, count(DISTINCT cls) AS n_present FROM mask GROUP BY utt, frame_id),
  m AS (SELECT frame_id, cls, row_number() OVER (PARTITION BY frame_id ORDER BY count(*) DESC, cls) AS r FROM mask GROUP BY frame_id, cls)
  SELECT utt, frame_id, {', '.join(f"{d6(f'share_{c}')} AS share_{c}" for c in range(4))}, n_present, CAST(cls AS BIGINT) AS dominant
  FROM s JOIN m USING (frame_id) WHERE r = 1""")
def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shares(frames.class_distribution(B.masks(spark, sf_dir), KEY, "mask", 4))


@query("mean_class_distribution", f"""WITH {B.MASK_SQL}, s AS (SELECT utt, frame_id, {SHARES_SQL} FROM mask GROUP BY utt, frame_id)
  SELECT utt, {', '.join(f"{d6(f'avg(share_{c})')} AS share_{c}" for c in range(4))}, count(*) AS n_frames FROM s GROUP BY utt""")
def mean_class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shares(frames.mean_class_distribution(B.masks(spark, sf_dir), ["utt"], ["frame_id"], "mask", 4))


def linspace_picks(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    sizes = scale.group_size(B.frames(spark, sf_dir), ["utt"])
    return series.linspace_positions(sizes, "n", k).withColumn("sample", F.col("sample").cast("long"))


@query("label_frame_join", f"""WITH {B.FRAMES_SQL}, picks AS (SELECT utt, i AS sample, i * (n - 1) // 9 AS frame_idx
    FROM (SELECT utt, count(*) AS n, unnest(range(0, 10)) AS i FROM frames GROUP BY utt))
  SELECT utt, CAST(sample AS BIGINT) AS sample, CAST(frame_idx AS BIGINT) AS frame_idx, frame_id, {d6('list_sum(pixels)')} AS total
  FROM picks JOIN frames USING (utt, frame_idx)""")
def label_frame_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = linspace_picks(spark, sf_dir, 10).drop("n")
    joined = selection.label_frame_join(labels, B.indexed_frames(spark, sf_dir), ["utt", "frame_idx"])
    return joined.select("utt", "sample", "frame_idx", "frame_id", C.r6(C.array_sum(F.col("pixels"))).alias("total"))


@query("extraction_stats", """WITH s AS (SELECT CAST(label AS BIGINT) AS utt, count(*) AS n FROM embeddings GROUP BY label)
  SELECT utt, count(*) AS n_utterances, CAST(sum(n) AS BIGINT) AS n_frames, CAST(64 AS BIGINT) AS n_params FROM s GROUP BY ROLLUP (utt)""")
def extraction_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.extraction_stats(B.frames(spark, sf_dir), "utt", F.size("pixels"))


def draw_sql(step: str) -> str:
    return f"(CAST('0x' || substr(md5('42:' || frame_id || ':{step}'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


FLIP_SQL = f"""flipped AS (SELECT utt, frame_id, y, CASE WHEN {draw_sql('flip')} > 0.5 THEN {S - 1} - x ELSE x END AS x, v, cls FROM mask_px),
bright AS (SELECT utt, frame_id, y, x, cls, CASE WHEN {draw_sql('brightness')} > 0.5
    THEN greatest(0, least(1, v * (0.8 + {draw_sql('brightness_factor')} * 0.4))) ELSE v END AS v FROM turned),
mean AS (SELECT frame_id, avg(v) AS m FROM bright GROUP BY frame_id)
SELECT utt, frame_id, y, x, CAST(cls AS BIGINT) AS cls, {d6(f"CASE WHEN {draw_sql('contrast')} > 0.5 THEN greatest(0, least(1, (v - m) * (0.8 + {draw_sql('contrast_factor')} * 0.4) + m)) ELSE v END")} AS value
FROM bright JOIN mean USING (frame_id)"""
MASK_PX_SQL = f"""{B.MASK_SQL}, mask_px AS (SELECT utt, frame_id, y, x, px.v, mask.cls FROM px JOIN mask USING (utt, frame_id, frame_idx, y, x))"""


def augmented(spark: SparkSession, sf_dir: str, rotate: bool) -> DataFrame:
    df = B.frames(spark, sf_dir).withColumn("mask", C.digitize_frame(F.col("pixels"), B.MASK_THRESHOLDS))
    done = frames.augment(df, ["frame_id"], "pixels", "mask", S, S, 42, rotate)
    both = done.withColumn("both", F.arrays_zip("pixels", "mask"))
    rows = frames.pixel_rows(both, KEY, "both", S, "b")
    return rows.select(*KEY, "y", "x", F.col("b.mask").cast("long").alias("cls"), C.r6(F.col("b.pixels")).alias("value"))


@query("augment_plain", f"WITH {MASK_PX_SQL}, {FLIP_SQL.replace('bright AS', 'turned AS (SELECT * FROM flipped), bright AS', 1)}")
def augment_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return augmented(spark, sf_dir, rotate=False)


ROTATE_SQL = f"""deg AS (SELECT frame_id, CASE WHEN {draw_sql('rotate')} > 0.5 THEN radians(({draw_sql('angle')} - 0.5) * 20) END AS a FROM frames),
place AS (SELECT f.utt, f.frame_id, f.y, f.x, a, f.v AS v0, f.cls AS c0,
    ((cos(a) * ((2 * f.x + 1) / {S}.0 - 1) - sin(a) * ((2 * f.y + 1) / {S}.0 - 1) + 1) * {S} - 1) / 2 AS sx,
    ((sin(a) * ((2 * f.x + 1) / {S}.0 - 1) + cos(a) * ((2 * f.y + 1) / {S}.0 - 1) + 1) * {S} - 1) / 2 AS sy
  FROM flipped f JOIN deg USING (frame_id)),
corners AS (SELECT p.*, dy, dx, CAST(floor(sy) AS BIGINT) + dy AS qy, CAST(floor(sx) AS BIGINT) + dx AS qx,
    (CASE WHEN dy = 0 THEN 1 - (sy - floor(sy)) ELSE sy - floor(sy) END) * (CASE WHEN dx = 0 THEN 1 - (sx - floor(sx)) ELSE sx - floor(sx) END) AS w
  FROM place p, (VALUES (0), (1)) d1(dy), (VALUES (0), (1)) d2(dx) WHERE a IS NOT NULL),
blended AS (SELECT c.utt, c.frame_id, c.y, c.x, sum(w * coalesce(f.v, 0)) AS v, sum(w * coalesce(f.cls, 0)) AS cls
  FROM corners c LEFT JOIN flipped f ON f.frame_id = c.frame_id AND f.y = c.qy AND f.x = c.qx GROUP BY ALL),
turned AS (SELECT utt, frame_id, y, x, v, CAST(floor(cls + 1e-9) AS BIGINT) AS cls FROM blended
  UNION ALL SELECT utt, frame_id, y, x, v0, c0 FROM place WHERE a IS NULL), bright AS"""


@query("augment", f"WITH {MASK_PX_SQL}, {FLIP_SQL.replace('bright AS', ROTATE_SQL, 1)}")
def augment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return augmented(spark, sf_dir, rotate=True)


@query("frame_transform", f"WITH {B.MASK_SQL} SELECT utt, frame_id, y, x, {d6('1 - v')} AS value, CAST(3 - cls AS BIGINT) AS cls FROM px JOIN mask USING (utt, frame_id, frame_idx, y, x)")
def frame_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = B.frames(spark, sf_dir).withColumn("mask", C.digitize_frame(F.col("pixels"), B.MASK_THRESHOLDS))
    done = frames.frame_transform(df, "pixels", "mask", lambda images, masks: (1 - images, 3 - masks))
    rows = frames.pixel_rows(done.withColumn("both", F.arrays_zip("pixels", "mask")), KEY, "both", S, "b")
    return rows.select(*KEY, "y", "x", C.r6(F.col("b.pixels")).alias("value"), F.col("b.mask").cast("long").alias("cls"))


@query("utterance_store", f"WITH {B.FRAMES_SQL} SELECT utt, frame_id, CAST(frame_idx AS BIGINT) AS frame_idx, {d6('list_sum(pixels)')} AS total FROM frames")
def utterance_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = new_location(spark, "utterances")
    df = B.indexed_frames(spark, sf_dir).withColumn("subject", F.col("utt") % 5)
    stores.write_utterances(df, where, ["subject"], ["utt", "frame_idx"])
    back = stores.read_utterances(spark, where, ["utt", "frame_id", "frame_idx", "pixels", "no_such_key"])
    return back.select("utt", "frame_id", "frame_idx", C.r6(C.array_sum(F.col("pixels"))).alias("total"))


@query("feature_store", f"""WITH {B.MASK_SQL}, s AS (SELECT utt, frame_id, {SHARES_SQL} FROM mask GROUP BY utt, frame_id)
  SELECT CAST(utt AS BIGINT) AS utt, frame_id, {d6('share_1')} AS share_1 FROM s""")
def feature_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = new_location(spark, "features")
    shares = frames.class_distribution(B.masks(spark, sf_dir), KEY, "mask", 4)
    stores.write_features(shares.select("utt", "frame_id", "share_1"), where, "geometric", "utt", ["frame_id"])
    stores.write_features(shares.select("utt", "frame_id", "share_2"), where, "other", "utt", ["frame_id"])
    kept = stores.read_features(spark, where, "geometric")
    return kept.select(F.col("utt").cast("long").alias("utt"), "frame_id", C.r6(F.col("share_1")).alias("share_1"))
