"""Queries on masks: thresholds, regions, parameters, scores, PCA."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalgrid import fixed
from vocalgrid.functions import columns as C
from vocalgrid.functions import kernels
from vocalgrid.operators import frames, geometry, pca, scores, segmentation, series
from vocalgrid.plans import binding as B
from vocalgrid.plans.catalog import d6, query
from vocalgrid.session import new_location

S = B.SIDE
KEY = ["utt", "frame_id"]


def rounded(df: DataFrame, names) -> DataFrame:
    return df.select(*[C.r6(F.col(c)).alias(c) if c in names else F.col(c) for c in df.columns])


# Geometric parameters ---------------------------------------------------------------------------

# One row per frame: each parameter straight from its definition.
GEOMETRY_SQL = f"""{B.MASK_SQL},
p20 AS (SELECT frame_id, quantile_cont(y, 0.2) AS cut FROM mask WHERE cls = 1 GROUP BY frame_id),
dorsum AS (SELECT frame_id, avg(y) AS d FROM mask JOIN p20 USING (frame_id) WHERE cls = 1 AND y <= cut GROUP BY frame_id),
rows AS (SELECT frame_id, y, count(*) AS n FROM mask WHERE cls > 0 GROUP BY frame_id, y),
narrow AS (SELECT frame_id, min(n) AS n, arg_min(y, n * 1000 + y) AS y FROM rows GROUP BY frame_id),
per AS (SELECT utt, frame_id, count(*) FILTER (cls = 1) AS a1, avg(x) FILTER (cls = 1) AS x1, avg(y) FILTER (cls = 1) AS y1,
    min(y) FILTER (cls = 1) AS t1, max(x) FILTER (cls = 1) - min(x) FILTER (cls = 1) AS w1,
    count(*) FILTER (cls = 2) AS a2, avg(y) FILTER (cls = 2) AS y2, max(y) FILTER (cls = 2) - min(y) FILTER (cls = 2) AS o2,
    count(*) FILTER (cls = 3) AS a3, avg(y) FILTER (cls = 3) AS y3, max(y) FILTER (cls = 3) - min(y) FILTER (cls = 3) AS o3
  FROM mask GROUP BY utt, frame_id),
geo AS (SELECT utt, frame_id, a1 / 64 AS tongue_area, coalesce(x1 / 8, 0) AS tongue_centroid_x, coalesce(y1 / 8, 0) AS tongue_centroid_y,
    coalesce(t1 / 8, 0) AS tongue_tip_y, coalesce(d / 8, 0) AS tongue_dorsum_height, coalesce(w1 / 8, 0) AS tongue_width,
    a2 / 64 AS jaw_area, coalesce(y2 / 8, 0) AS jaw_centroid_y, coalesce(o2 / 8, 0) AS jaw_opening,
    a3 / 64 AS lip_area, coalesce(y3 / 8, 0) AS lip_centroid_y, coalesce(o3 / 8, 0) AS lip_aperture,
    coalesce(n / 8, 0) AS constriction_degree, coalesce(y / 8, 0) AS constriction_location_y
  FROM per LEFT JOIN dorsum USING (frame_id) LEFT JOIN narrow USING (frame_id))"""


def geometry_columns_sql(prefix: str = "") -> str:
    return ", ".join(f"{d6(n)} AS {n}" for n in fixed.GEOMETRIC_FEATURES if n.startswith(prefix))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.geometric_features(B.masks(spark, sf_dir), KEY, "mask", S, S)


@query("geometric_features", f"WITH {GEOMETRY_SQL} SELECT utt, frame_id, {geometry_columns_sql()} FROM geo")
def geometric_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features(spark, sf_dir), fixed.GEOMETRIC_FEATURES)


@query("geometric_features_sql", f"WITH {GEOMETRY_SQL} SELECT utt, frame_id, {geometry_columns_sql()} FROM geo")
def geometric_features_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = geometry.geometric_features_sql(B.masks(spark, sf_dir), KEY, "mask", S, S)
    return rounded(out, fixed.GEOMETRIC_FEATURES)


@query("geometric_means", f"WITH {GEOMETRY_SQL} SELECT utt, count(*) AS n_frames, " + ", ".join(f"{d6(f'avg({n})')} AS {n}" for n in fixed.GEOMETRIC_FEATURES) + " FROM geo GROUP BY utt")
def geometric_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = [F.avg(n).alias(n) for n in fixed.GEOMETRIC_FEATURES]
    out = features(spark, sf_dir).groupBy("utt").agg(F.count(F.lit(1)).alias("n_frames"), *means)
    return rounded(out, fixed.GEOMETRIC_FEATURES)


def _group_query(name: str, prefix: str) -> None:
    @query(name, f"WITH {GEOMETRY_SQL} SELECT utt, frame_id, {geometry_columns_sql(prefix)} FROM geo")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(geometry.feature_group(features(spark, sf_dir), KEY, prefix), fixed.GEOMETRIC_FEATURES)


for _name, _prefix in (("tongue_features", "tongue"), ("jaw_features", "jaw"), ("lip_features", "lip"), ("constriction", "constriction")):
    _group_query(_name, _prefix)


# Thresholds -------------------------------------------------------------------------------------


def histogram_sql(source: str, bins: int) -> str:
    """hist(frame_id, lo, hi, bin, c) and otsu(frame_id, threshold) of pixels (frame_id, v)."""
    return f"""ends AS (SELECT frame_id, min(v) AS lo, max(v) AS hi FROM {source} GROUP BY frame_id),
hist AS (SELECT frame_id, lo, hi, CASE WHEN hi > lo THEN CAST(least(floor((v - lo) / (hi - lo) * {bins}), {bins - 1}) AS BIGINT) ELSE 0 END AS bin, count(*)::DOUBLE AS c
  FROM {source} JOIN ends USING (frame_id) GROUP BY ALL),
sums AS (SELECT frame_id, lo, hi, bin, sum(c) OVER b AS w1, sum(c * bin) OVER b AS s1, sum(c) OVER f - sum(c) OVER b AS w2,
    sum(c * bin) OVER f - sum(c * bin) OVER b AS s2
  FROM hist WINDOW f AS (PARTITION BY frame_id), b AS (PARTITION BY frame_id ORDER BY bin)),
best AS (SELECT frame_id, lo, hi, bin, row_number() OVER (PARTITION BY frame_id
    ORDER BY CASE WHEN w2 > 0 THEN (s1 * w2 - s2 * w1) ** 2 / (w1 * w2) ELSE -1 END DESC, bin) AS r FROM sums),
otsu AS (SELECT frame_id, CASE WHEN hi > lo THEN lo + (bin + 0.5::DOUBLE) * (hi - lo) / {bins} ELSE 0.5 END AS threshold FROM best WHERE r = 1)"""


@query("otsu_threshold", f"WITH {B.PIXELS_SQL}, {histogram_sql('px', 256)} SELECT utt, frame_id, {d6('threshold')} AS threshold FROM frames JOIN otsu USING (frame_id)")
def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(segmentation.otsu_threshold(B.frames(spark, sf_dir), KEY, "pixels", 256), ["threshold"])


def folded(place: str, size: int) -> str:
    """SQL: index reflected at the ends with the edge repeated."""
    turn = f"((({place}) % {2 * size} + {2 * size}) % {2 * size})"
    return f"CASE WHEN {turn} < {size} THEN {turn} ELSE {2 * size - 1} - {turn} END"


def _weights() -> str:
    rows = ", ".join(f"({i - 4}, {float(w)!r}::DOUBLE)" for i, w in enumerate(kernels.gaussian(4, 1.0)))
    return f"g(k, w) AS (VALUES {rows})"


# The stand-in pixels lie in about -0.6..0.6, far below the 1 that would rescale a frame.
SMOOTH_SQL = f"""{B.PIXELS_SQL}, {_weights()},
across AS (SELECT p.utt, p.frame_id, p.y, p.x, sum(g.w * q.v) AS v FROM px p, g JOIN px q
  ON q.frame_id = p.frame_id AND q.y = p.y AND q.x = {folded('p.x + g.k', S)} GROUP BY ALL),
smooth AS (SELECT p.utt, p.frame_id, p.y, p.x, sum(g.w * q.v) AS v FROM across p, g JOIN across q
  ON q.frame_id = p.frame_id AND q.x = p.x AND q.y = {folded('p.y + g.k', S)} GROUP BY ALL)"""
TISSUE_SQL = f"""{SMOOTH_SQL}, {histogram_sql('smooth', 256)},
tissue AS (SELECT utt, frame_id, y, x, CASE WHEN v > threshold THEN 1 ELSE 0 END AS tissue, threshold FROM smooth JOIN otsu USING (frame_id))"""


def mask_pixels(df: DataFrame, column: str, keys: list[str] = KEY) -> DataFrame:
    rows = frames.pixel_rows(df, keys, column, S, column)
    return rows.withColumn(column, F.col(column).cast("long"))


@query("tissue_mask", f"WITH {TISSUE_SQL} SELECT utt, frame_id, {d6('threshold')} AS threshold, y, x, CAST(tissue AS BIGINT) AS tissue FROM tissue")
def tissue_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = segmentation.tissue_mask(B.frames(spark, sf_dir), "pixels", S, S)
    return rounded(mask_pixels(held, "tissue", [*KEY, "threshold"]), ["threshold"])


OTSU_BINS = 16


@query("multi_otsu", f"""WITH {B.PIXELS_SQL}, {histogram_sql('px', OTSU_BINS)},
  grid AS (SELECT f.frame_id, b.bin, coalesce(h.c, 0) AS c FROM frames f, (SELECT unnest(range(0, {OTSU_BINS})) AS bin) b
    LEFT JOIN hist h ON h.frame_id = f.frame_id AND h.bin = b.bin),
  cum AS (SELECT frame_id, bin, sum(c) OVER w AS n, sum(c * bin) OVER w AS s FROM grid WINDOW w AS (PARTITION BY frame_id ORDER BY bin)),
  tot AS (SELECT frame_id, n, s FROM cum WHERE bin = {OTSU_BINS - 1}),
  pairs AS (SELECT a.frame_id, a.bin AS b1, b.bin AS b2,
      round(a.s * a.s / a.n + round((b.s - a.s) ** 2 / (b.n - a.n) + (t.s - b.s) ** 2 / (t.n - b.n), 9), 9) AS v
    FROM cum a JOIN cum b ON b.frame_id = a.frame_id AND b.bin > a.bin JOIN tot t ON t.frame_id = a.frame_id
    WHERE a.n > 0 AND b.n > a.n AND t.n > b.n),
  pick AS (SELECT frame_id, b1, b2 FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY v DESC, b1, b2) AS r FROM pairs) WHERE r = 1),
  thr AS (SELECT frame_id, lo + (b1 + 0.5::DOUBLE) * (hi - lo) / {OTSU_BINS} AS t1, lo + (b2 + 0.5::DOUBLE) * (hi - lo) / {OTSU_BINS} AS t2 FROM pick JOIN ends USING (frame_id))
  SELECT utt, frame_id, {d6('t1')} AS t1, {d6('t2')} AS t2, y, x, CAST((v >= t1)::INT + (v >= t2)::INT AS BIGINT) AS classes FROM px JOIN thr USING (frame_id)""")
def multi_otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = segmentation.multi_otsu(B.frames(spark, sf_dir), "pixels", S, S, 3, OTSU_BINS, sigma=0.0)
    held = held.withColumn("t1", F.col("thresholds")[0]).withColumn("t2", F.col("thresholds")[1])
    return rounded(mask_pixels(held, "classes", [*KEY, "t1", "t2"]), ["t1", "t2"])


FOUR_BINS = 32


@query("multi_otsu_four", f"""WITH {B.PIXELS_SQL}, {histogram_sql('px', FOUR_BINS)},
  grid AS (SELECT f.frame_id, b.bin, coalesce(h.c, 0) AS c FROM frames f, (SELECT unnest(range(0, {FOUR_BINS})) AS bin) b
    LEFT JOIN hist h ON h.frame_id = f.frame_id AND h.bin = b.bin),
  cum AS (SELECT frame_id, bin, sum(c) OVER w AS n, sum(c * bin) OVER w AS s FROM grid WINDOW w AS (PARTITION BY frame_id ORDER BY bin)),
  tot AS (SELECT frame_id, n, s FROM cum WHERE bin = {FOUR_BINS - 1}),
  sets AS (SELECT a.frame_id, a.bin AS b1, b.bin AS b2, c.bin AS b3, round(a.s * a.s / a.n + round((b.s - a.s) ** 2 / (b.n - a.n)
        + round((c.s - b.s) ** 2 / (c.n - b.n) + (t.s - c.s) ** 2 / (t.n - c.n), 9), 9), 9) AS v
    FROM cum a JOIN cum b ON b.frame_id = a.frame_id AND b.bin > a.bin JOIN cum c ON c.frame_id = a.frame_id AND c.bin > b.bin
    JOIN tot t ON t.frame_id = a.frame_id WHERE a.n > 0 AND b.n > a.n AND c.n > b.n AND t.n > c.n),
  pick AS (SELECT frame_id, b1, b2, b3 FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY v DESC, b1, b2, b3) AS r FROM sets) WHERE r = 1),
  thr AS (SELECT frame_id, list_transform([b1, b2, b3], lambda b: lo + (b + 0.5::DOUBLE) * (hi - lo) / {FOUR_BINS}) AS t FROM pick JOIN ends USING (frame_id))
  SELECT utt, frame_id, y, x, CAST((v >= t[1])::INT + (v >= t[2])::INT + (v >= t[3])::INT AS BIGINT) AS classes FROM px JOIN thr USING (frame_id)""")
def multi_otsu_four(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = segmentation.multi_otsu(B.frames(spark, sf_dir), "pixels", S, S, 4, FOUR_BINS, sigma=0.0)
    return mask_pixels(held, "classes")


# Regions ----------------------------------------------------------------------------------------


def binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = B.frames(spark, sf_dir)
    return df.withColumn("m", F.transform("pixels", lambda v: (v >= 0.02).cast("int")))


def region_sql(source: str, condition: str, out: str, connectivity: int) -> str:
    """{out}(utt, frame_id, y, x, region): a walk over neighbouring pixels; the least pixel names it."""
    near = "abs(p.y - w.y) <= 1 AND abs(p.x - w.x) <= 1" if connectivity == 8 else "abs(p.y - w.y) + abs(p.x - w.x) <= 1"
    return f"""{out}_px AS (SELECT utt, frame_id, y, x, y * 1000 + x AS id FROM {source} WHERE {condition}),
{out}_walk AS (SELECT frame_id, id AS root, y, x FROM {out}_px
  UNION SELECT w.frame_id, w.root, p.y, p.x FROM {out}_walk w JOIN {out}_px p ON p.frame_id = w.frame_id AND {near} AND p.id > w.root),
{out} AS (SELECT p.utt, p.frame_id, p.y, p.x, r.region FROM {out}_px p
  JOIN (SELECT frame_id, y, x, min(root) AS region FROM {out}_walk GROUP BY frame_id, y, x) r USING (frame_id, y, x))"""


def largest_sql(regions: str, out: str) -> str:
    return f"""{out} AS (SELECT frame_id, region FROM (SELECT frame_id, region, row_number() OVER (PARTITION BY frame_id ORDER BY count(*) DESC, region) AS r
  FROM {regions} GROUP BY frame_id, region) WHERE r = 1)"""


# tract(utt, frame_id, y, x, tissue, threshold, tract): background not reached from outside is
# filled, then grown and shrunk by a disk of radius 3, then the largest region is kept.
TRACT_SQL = f"""{TISSUE_SQL},
ring AS (SELECT f.utt, f.frame_id, a.i // {S + 2} - 1 AS y, a.i % {S + 2} - 1 AS x FROM (SELECT DISTINCT utt, frame_id FROM frames) f, (SELECT unnest(range(0, {(S + 2) ** 2})) AS i) a),
back AS (SELECT r.utt, r.frame_id, r.y, r.x FROM ring r LEFT JOIN tissue t USING (frame_id, y, x) WHERE coalesce(t.tissue, 0) = 0),
outer_walk AS (SELECT frame_id, y, x FROM back WHERE y = -1 AND x = -1
  UNION SELECT b.frame_id, b.y, b.x FROM outer_walk w JOIN back b ON b.frame_id = w.frame_id AND abs(b.y - w.y) + abs(b.x - w.x) = 1),
filled AS (SELECT t.utt, t.frame_id, t.y, t.x FROM tissue t LEFT JOIN outer_walk o USING (frame_id, y, x) WHERE o.frame_id IS NULL),
grown AS (SELECT DISTINCT t.utt, t.frame_id, t.y, t.x FROM tissue t JOIN filled f ON f.frame_id = t.frame_id AND (f.y - t.y) ** 2 + (f.x - t.x) ** 2 <= 9),
closed AS (SELECT t.utt, t.frame_id, t.y, t.x FROM tissue t LEFT JOIN (SELECT DISTINCT c.frame_id, c.y, c.x FROM tissue c
    JOIN (SELECT a.frame_id, a.y, a.x FROM tissue a ANTI JOIN grown g USING (frame_id, y, x)) o
    ON o.frame_id = c.frame_id AND (o.y - c.y) ** 2 + (o.x - c.x) ** 2 <= 9) lost USING (frame_id, y, x) WHERE lost.frame_id IS NULL),
{region_sql('closed', 'true', 'tr', 8)}, {largest_sql('tr', 'tr_best')},
tract AS (SELECT t.*, CASE WHEN b.frame_id IS NULL OR r.region = b.region THEN 1 ELSE 0 END AS tract
  FROM tissue t LEFT JOIN tr_best b USING (frame_id) LEFT JOIN tr r ON r.frame_id = t.frame_id AND r.y = t.y AND r.x = t.x)"""

RULE_SQL = """CASE WHEN tissue = 0 OR tract = 0 THEN 0 WHEN x < 1 OR x >= 6 THEN 3
    WHEN y >= 1 AND y < 7 AND x >= 1 AND x < 7 THEN CASE WHEN y >= 3 THEN 1 ELSE 2 END ELSE 0 END"""

# Frames of the best utterance of each subject (two utterances each), ten spread evenly.
PSEUDO_SQL = f"""RECURSIVE {TRACT_SQL},
utts AS (SELECT utt, utt // 2 AS subject, count(*) AS n, avg(pixels[1]) AS correlation FROM frames GROUP BY utt),
chosen AS (SELECT utt, n FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY correlation DESC, utt) AS r FROM utts) WHERE r = 1),
picks AS (SELECT utt, sample, sample * (n - 1) // 9 AS frame_idx FROM (SELECT utt, n, unnest(range(0, 10)) AS sample FROM chosen)),
pseudo AS (SELECT k.utt, f.frame_id, k.sample, t.threshold, t.y, t.x, {RULE_SQL} AS label
  FROM picks k JOIN frames f USING (utt, frame_idx) JOIN tract t ON t.frame_id = f.frame_id)"""


PSEUDO_BINS = 64
# The same frames by three intensity classes of the smoothed frame.
PSEUDO_OTSU_SQL = f"""{SMOOTH_SQL},
utts AS (SELECT utt, utt // 2 AS subject, count(*) AS n, avg(pixels[1]) AS correlation FROM frames GROUP BY utt),
chosen AS (SELECT utt, n FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY correlation DESC, utt) AS r FROM utts) WHERE r = 1),
picks AS (SELECT utt, sample, sample * (n - 1) // 9 AS frame_idx FROM (SELECT utt, n, unnest(range(0, 10)) AS sample FROM chosen)),
picked AS (SELECT k.utt, k.sample, f.frame_id, s.y, s.x, s.v FROM picks k JOIN frames f USING (utt, frame_idx) JOIN smooth s USING (frame_id)),
seen AS (SELECT DISTINCT frame_id, y, x, v FROM picked), {histogram_sql('seen', PSEUDO_BINS)},
grid AS (SELECT f.frame_id, b.bin, coalesce(h.c, 0) AS c FROM ends f, (SELECT unnest(range(0, {PSEUDO_BINS})) AS bin) b
  LEFT JOIN hist h ON h.frame_id = f.frame_id AND h.bin = b.bin),
cum AS (SELECT frame_id, bin, sum(c) OVER w AS n, sum(c * bin) OVER w AS s FROM grid WINDOW w AS (PARTITION BY frame_id ORDER BY bin)),
tot AS (SELECT frame_id, n, s FROM cum WHERE bin = {PSEUDO_BINS - 1}),
cuts AS (SELECT a.frame_id, a.bin AS b1, b.bin AS b2,
    round(a.s * a.s / a.n + round((b.s - a.s) ** 2 / (b.n - a.n) + (t.s - b.s) ** 2 / (t.n - b.n), 9), 9) AS v
  FROM cum a JOIN cum b ON b.frame_id = a.frame_id AND b.bin > a.bin JOIN tot t ON t.frame_id = a.frame_id
  WHERE a.n > 0 AND b.n > a.n AND t.n > b.n),
pick AS (SELECT frame_id, b1, b2 FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY v DESC, b1, b2) AS r FROM cuts) WHERE r = 1),
thr AS (SELECT frame_id, lo + (b1 + 0.5::DOUBLE) * (hi - lo) / {PSEUDO_BINS} AS t1, lo + (b2 + 0.5::DOUBLE) * (hi - lo) / {PSEUDO_BINS} AS t2 FROM pick JOIN ends USING (frame_id))"""


@query("tissue_mask_min_area", f"""WITH RECURSIVE {B.PIXELS_SQL}, {region_sql('px', 'v > 0.05', 'r4', 4)},
  sizes AS (SELECT frame_id, region, count(*) AS n FROM r4 GROUP BY frame_id, region)
  SELECT p.utt, p.frame_id, p.y, p.x, CAST(coalesce(s.n >= 4, false) AS BIGINT) AS tissue
  FROM px p LEFT JOIN r4 USING (frame_id, y, x) LEFT JOIN sizes s ON s.frame_id = p.frame_id AND s.region = r4.region""")
def tissue_mask_min_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = segmentation.tissue_mask(B.frames(spark, sf_dir), "pixels", S, S, sigma=0.0, threshold=0.05, min_area=4)
    return mask_pixels(held, "tissue")


@query("region_label", f"""WITH RECURSIVE {B.PIXELS_SQL}, {region_sql('px', 'v >= 0.02', 'r8', 8)}, {region_sql('px', 'v >= 0.02', 'r4', 4)}, {largest_sql('r8', 'best')},
  sizes AS (SELECT frame_id, region, count(*) AS n FROM r4 GROUP BY frame_id, region)
  SELECT p.utt, p.frame_id, p.y, p.x, CAST(coalesce(r8.region // 1000 * {S} + r8.region % 1000 + 1, 0) AS BIGINT) AS region,
    CAST(coalesce(s.n >= 5, false) AS BIGINT) AS big, CAST(coalesce(r8.region = best.region, false) AS BIGINT) AS largest
  FROM px p LEFT JOIN r8 USING (frame_id, y, x) LEFT JOIN r4 USING (frame_id, y, x)
  LEFT JOIN sizes s ON s.frame_id = p.frame_id AND s.region = r4.region LEFT JOIN best ON best.frame_id = p.frame_id""")
def region_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = binary(spark, sf_dir)
    held = held.withColumn("region", segmentation.region_label(S, S, 8)(F.col("m")))
    held = held.withColumn("big", segmentation.drop_small(S, S, 5)(F.col("m")))
    held = held.withColumn("largest", segmentation.largest_region(S, S, 8)(F.col("m")))
    zipped = held.withColumn("all", F.arrays_zip("region", "big", "largest"))
    rows = frames.pixel_rows(zipped, KEY, "all", S, "a")
    return rows.select(*KEY, "y", "x", *[F.col(f"a.{n}").cast("long").alias(n) for n in ("region", "big", "largest")])


@query("vocal_tract_mask", f"WITH RECURSIVE {TRACT_SQL} SELECT utt, frame_id, y, x, CAST(tract AS BIGINT) AS tract FROM tract")
def vocal_tract_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = segmentation.tissue_mask(B.frames(spark, sf_dir), "pixels", S, S)
    return mask_pixels(held.withColumn("tract", segmentation.vocal_tract_mask(S, S)(F.col("tissue"))), "tract")


@query("label_rules", f"""WITH {TISSUE_SQL}
  SELECT utt, frame_id, y, x, CAST(CASE WHEN tissue = 0 THEN 0 WHEN x < 1 OR x >= 6 THEN 3
    WHEN y >= 1 AND y < 7 AND x >= 1 AND x < 7 THEN CASE WHEN y >= 3 THEN 1 ELSE 2 END ELSE 0 END AS BIGINT) AS label FROM tissue""")
def label_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = segmentation.tissue_mask(B.frames(spark, sf_dir), "pixels", S, S)
    everywhere = F.transform("tissue", lambda t: F.lit(1))
    held = held.withColumn("tract", everywhere)
    return mask_pixels(held.withColumn("label", segmentation.label_rules(F.col("tissue"), F.col("tract"), S, S)), "label")


# Scores: the prediction for a frame is the next frame's mask --------------------------------------


def mask_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = B.indexed_frames(spark, sf_dir).withColumn("target", C.digitize_frame(F.col("pixels"), B.MASK_THRESHOLDS))
    narrow = df.select("utt", "frame_idx", "target")
    return series.with_next(narrow, ["utt"], "frame_idx", {"target": "predicted"}, block=frames.BLOCK).where("predicted IS NOT NULL")


DICE_SQL = f"""{B.MASK_SQL}, pair AS (SELECT a.utt, a.frame_idx, a.cls AS t, b.cls AS p FROM mask a JOIN mask b
    ON b.utt = a.utt AND b.frame_idx = a.frame_idx + 1 AND b.y = a.y AND b.x = a.x),
cs AS (SELECT unnest(range(0, 5)) AS cls),
n AS (SELECT utt, frame_idx, cs.cls, count(*) FILTER (p = cs.cls AND t = cs.cls) AS i, count(*) FILTER (p = cs.cls) + count(*) FILTER (t = cs.cls) AS u,
    avg(CASE WHEN p = t THEN 1 ELSE 0 END) AS acc FROM pair, cs GROUP BY utt, frame_idx, cs.cls),
dice AS (SELECT utt, frame_idx, cls, (2 * i + 1e-7) / (u + 1e-7) AS dice, (i + 1e-7) / (u - i + 1e-7) AS iou, acc FROM n)"""


@query("dice_iou", f"""WITH {DICE_SQL} SELECT utt, CAST(frame_idx AS BIGINT) AS frame_idx, CAST(cls AS BIGINT) AS cls, {d6('dice')} AS dice, {d6('iou')} AS iou, {d6('acc')} AS pixel_accuracy FROM dice""")
def dice_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scores.dice_iou(mask_pairs(spark, sf_dir), ["utt", "frame_idx"], "predicted", "target", 5)
    return rounded(out, ["dice", "iou", "pixel_accuracy"])


@query("macro_eval", f"""WITH {DICE_SQL}, s AS (SELECT utt, frame_idx, avg(dice) AS d, avg(iou) AS i, avg(acc) AS a FROM dice GROUP BY ALL)
  SELECT CAST(cls AS BIGINT) AS cls, {d6('avg(dice)')} AS dice, {d6('avg(iou)')} AS iou, CAST(NULL AS DOUBLE) AS pixel_accuracy FROM dice GROUP BY cls
  UNION ALL SELECT NULL, {d6('avg(d)')}, {d6('avg(i)')}, {d6('avg(a)')} FROM s""")
def macro_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["utt", "frame_idx"]
    per = scores.dice_iou(mask_pairs(spark, sf_dir), keys, "predicted", "target", 5)
    return rounded(scores.macro_eval(per, keys), ["dice", "iou", "pixel_accuracy"])


# PCA --------------------------------------------------------------------------------------------

COMPONENTS = 10
# The mask's pixels in page order, as rows.
FLAT_SQL = f"{B.MASK_SQL}, flat AS (SELECT utt, frame_id, y * {S} + x AS pixel, cls FROM mask)"


def fitted(spark: SparkSession, sf_dir: str, k: int = COMPONENTS, whiten: bool = False) -> tuple[DataFrame, pca.MaskPCA]:
    masks = B.masks(spark, sf_dir)
    return masks, pca.fit(masks, "mask", S, S, k, whiten)


@query("pca_fit", f"""SELECT 'product' AS part, i AS component, j AS other, CASE WHEN i = j THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS value
  FROM range({COMPONENTS}) a(i), range({COMPONENTS}) b(j)
  UNION ALL SELECT 'residual', i, j, CAST(0 AS DOUBLE) FROM range({COMPONENTS}) a(i), range({S * S}) b(j)
  UNION ALL SELECT 'mean', NULL, pixel, value FROM (WITH {FLAT_SQL} SELECT pixel, {d6('avg(cls)')} AS value FROM flat GROUP BY pixel)""")
def pca_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What makes a vector a component: products of components, and covariance times component less variance times component.

    The covariance of each pixel with a score is summed over the table by Spark, apart from the fit.
    """
    masks, model = fitted(spark, sf_dir)
    kind = "part string, component long, other long, value double"
    products = model.components @ model.components.T
    rows = [("product", i, j, float(v)) for i, row in enumerate(products) for j, v in enumerate(row)]
    rows += [("mean", None, j, float(v)) for j, v in enumerate(model.mean)]
    sides = masks.select("mask", F.posexplode(pca.transform(model, F.col("mask"))).alias("component", "score"))
    sides = sides.select("component", "score", F.posexplode("mask").alias("other", "cls"))
    together = sides.groupBy("component", "other").agg(F.covar_samp("score", "cls").alias("c"))
    wanted = [(i, j, float(v * model.variances[i])) for i, row in enumerate(model.components) for j, v in enumerate(row)]
    named = spark.createDataFrame(wanted, "component int, other int, w double")
    residual = together.join(named, ["component", "other"]).select(
        F.lit("residual").alias("part"), F.col("component").cast("long").alias("component"), F.col("other").cast("long").alias("other"), (F.col("c") - F.col("w")).alias("value")
    )
    return rounded(spark.createDataFrame(rows, kind).unionByName(residual), ["value"])


@query("pca_transform", f"""SELECT c AS component, count(*) AS n_frames, CAST(0 AS DOUBLE) AS mean, CAST(1 AS DOUBLE) AS variance
  FROM embeddings, range({COMPONENTS}) k(c) GROUP BY c""")
def pca_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened scores have mean 0 and variance 1 in every component."""
    masks, model = fitted(spark, sf_dir, whiten=True)
    scored = masks.select(F.posexplode(pca.transform(model, F.col("mask"))).alias("component", "score"))
    out = scored.groupBy(F.col("component").cast("long").alias("component")).agg(
        F.count("score").alias("n_frames"), F.avg("score").alias("mean"), F.var_samp("score").alias("variance")
    )
    return rounded(out, ["mean", "variance"])


@query("pca_energy", f"""WITH {FLAT_SQL}, m AS (SELECT pixel, avg(cls) AS v FROM flat GROUP BY pixel)
  SELECT utt, frame_id, {d6('sum((cls - v) * (cls - v))')} AS energy FROM flat JOIN m USING (pixel) GROUP BY utt, frame_id""")
def pca_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With all components a frame's squared scores sum to its squared distance from the mean."""
    masks, model = fitted(spark, sf_dir, S * S)
    energy = F.aggregate(pca.transform(model, F.col("mask")), F.lit(0.0), lambda a, v: a + v * v)
    return rounded(masks.select(*KEY, energy.alias("energy")), ["energy"])


@query("pca_inverse", f"""WITH {B.MASK_SQL} SELECT utt, frame_id, y, x, CAST(cls AS DOUBLE) AS rebuilt FROM mask""")
def pca_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With all components and before truncation the mask comes back."""
    masks, model = fitted(spark, sf_dir, S * S)
    back = masks.withColumn("rebuilt", pca.inverse(model, pca.transform(model, F.col("mask")), classes=False))
    return rounded(frames.pixel_rows(back, KEY, "rebuilt", S, "rebuilt"), ["rebuilt"])


@query("pca_model_io", "SELECT CAST(label AS BIGINT) AS utt, vec_id AS frame_id, CAST(0 AS DOUBLE) AS gap FROM embeddings")
def pca_model_io(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a fitted model and of the same model stored and read again."""
    masks, model = fitted(spark, sf_dir)
    where = new_location(spark, "pca")
    pca.save(spark, model, where)
    again = pca.load(spark, where)
    gap = F.zip_with(
        pca.transform(model, F.col("mask")), pca.transform(again, F.col("mask")), lambda a, b: F.abs(a - b)
    )
    return rounded(masks.select(*KEY, F.array_max(gap).alias("gap")), ["gap"])


@query("explained_variance", f"""WITH {FLAT_SQL}, v AS (SELECT pixel, var_samp(cls) AS v FROM flat GROUP BY pixel)
  SELECT CAST({S * S} AS BIGINT) AS components, CAST(1 AS DOUBLE) AS share, true AS falling, {d6('sum(v)')} AS variance FROM v""")
def explained_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All components together explain all there is; their variances sum to those of the pixels."""
    _, model = fitted(spark, sf_dir, S * S)
    shares = pca.explained_variance(spark, model)
    out = shares.where("component is not null").agg(
        F.count(F.lit(1)).alias("components"), F.sum("share").alias("share"),
        F.array_sort(F.collect_list(F.struct("component", "share"))).alias("s"), F.lit(float(model.variances.sum())).alias("variance"),
    )
    falling = F.col("s.share") == F.reverse(F.array_sort("s.share"))
    return rounded(out.select("components", "share", falling.alias("falling"), "variance"), ["share", "variance"])
