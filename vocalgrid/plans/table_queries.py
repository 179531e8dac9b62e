"""Queries on subject and utterance tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalgrid import scale
from vocalgrid.functions import columns as C
from vocalgrid.operators import ordering, selection, summaries
from vocalgrid.plans import binding as B
from vocalgrid.plans.catalog import d6, query
from vocalgrid.session import new_location
from vocalgrid.sources import documents, listing, stores

# Path listing: the host is the subject, the file name is made from the page ----------------------


def page_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = B.table(spark, sf_dir, "pages").select("page_id", "url")
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    rest = F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1)
    i = F.col("page_id").cast("string")
    rel = (
        F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("2drt/video/"), i, F.lit(".mp4")))
        .when(F.col("page_id") % 5 == 1, F.concat(i, F.lit(".avi")))
        .when(F.col("page_id") % 5 == 2, F.concat(F.lit("frames/"), i, F.lit(".png")))
        .when(F.col("page_id") % 5 == 3, F.lit("metadata.json"))
        .otherwise(rest)
    )
    hidden = F.when(F.col("page_id") % 17 == 0, F.lit(".")).otherwise(F.lit(""))
    return pages.select("page_id", F.concat(hidden, host).alias("subject"), rel.alias("rel"))


LISTING_SQL = r"""listing AS (
  SELECT page_id, (CASE WHEN page_id % 17 = 0 THEN '.' ELSE '' END) || regexp_extract(url, '^https?://([^/]+)', 1) AS subject,
         CASE page_id % 5 WHEN 0 THEN '2drt/video/' || page_id || '.mp4' WHEN 1 THEN page_id || '.avi'
              WHEN 2 THEN 'frames/' || page_id || '.png' WHEN 3 THEN 'metadata.json'
              ELSE regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) END AS rel
  FROM pages)"""


@query("corpus_registry", f"""WITH {LISTING_SQL},
  seen AS (SELECT subject, bool_or(rel LIKE '2drt/video/%.mp4') AS v, bool_or(rel NOT LIKE '%/%' AND rel LIKE '%.avi') AS t,
                  bool_or(rel LIKE 'frames/%.png') AS f, bool_or(rel = 'metadata.json') AS m
           FROM listing WHERE subject NOT LIKE '.%' GROUP BY subject)
  SELECT subject AS subject_id, CASE WHEN v THEN subject || '/2drt/video' WHEN t THEN subject ELSE subject || '/frames' END AS mri_path,
         CASE WHEN v OR t THEN 'video_dir' ELSE 'frames' END AS mri_format,
         CASE WHEN v THEN subject || '/2drt/video' WHEN t THEN subject END AS audio_path,
         true AS audio_embedded, CASE WHEN m THEN subject || '/metadata.json' END AS metadata_path
  FROM seen WHERE v OR t OR f""")
def corpus_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.corpus_registry(page_listing(spark, sf_dir))


@query("registry_metadata", f"""WITH {LISTING_SQL},
  m AS (SELECT subject, min(page_id) AS page_id FROM listing WHERE rel = 'metadata.json' AND subject NOT LIKE '.%' GROUP BY subject),
  seen AS (SELECT subject FROM listing WHERE subject NOT LIKE '.%' GROUP BY subject
    HAVING bool_or(rel LIKE '2drt/video/%.mp4' OR (rel NOT LIKE '%/%' AND rel LIKE '%.avi') OR rel LIKE 'frames/%.png'))
  SELECT subject AS subject_id, subject AS directory, CASE WHEN page_id % 2 = 0 THEN page_id ELSE 83.28 END::DOUBLE AS fps,
    CASE WHEN page_id IS NOT NULL THEN 'page ' || page_id END AS note FROM seen LEFT JOIN m USING (subject)""")
def registry_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry with the metadata texts of its subjects parsed; here every second text names no rate."""
    files = page_listing(spark, sf_dir)
    first = files.where("rel = 'metadata.json'").groupBy("subject", "rel").agg(F.min("page_id").alias("i"))
    note = F.concat(F.lit("page "), F.col("i"))
    text = F.when(F.col("i") % 2 == 0, F.to_json(F.struct(F.col("i").alias("fps"), note.alias("note")))).otherwise(F.to_json(F.struct(note.alias("note"))))
    texts = first.select(F.concat_ws("/", "subject", "rel").alias("path"), text.alias("text"))
    held = listing.with_metadata(listing.corpus_registry(files), texts)
    return held.select("subject_id", "directory", "fps", F.col("metadata")["note"].alias("note"))


@query("file_listing")
def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = listing.file_listing(spark, sf_dir, "*.parquet", recursive=True)
    return files.select(C.file_name(F.col("path")).alias("file"), "length")


@query("manifest_explode", f"""WITH {B.SCORES_SQL}
  SELECT CAST(subject AS VARCHAR) AS subject_id, CAST(utt AS VARCHAR) AS utterance_name,
         correlation >= 0.3 AS alignment_valid, {d6('correlation')} AS correlation
  FROM scores""")
def manifest_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [
        F.col("utt").cast("string").alias("utterance_name"),
        F.lit(None).cast("string").alias("hdf5_path"),
        F.lit(None).cast("string").alias("metadata_path"),
        (F.col("correlation") >= 0.3).alias("alignment_valid"),
        F.col("correlation"),
    ]
    nested = documents.nest_manifest(B.scores(spark, sf_dir), "subject", "utt", fields)
    where = new_location(spark, "manifest")
    documents.write_documents(nested, where)
    schema = documents.MANIFEST_SCHEMA
    flat = documents.explode_manifest(spark.read.schema(schema).json(where))
    return flat.select("subject_id", "utterance_name", "alignment_valid", C.r6(F.col("correlation")).alias("correlation"))


@query("json_documents", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
  CAST(json_object('event_id', event_id, 'event_type', event_type, 'k', CAST(json_extract(props, '$.k') AS BIGINT)) AS VARCHAR) AS doc
  FROM events""")
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = B.table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    parsed = documents.from_documents(events, "props", "k BIGINT")
    return documents.to_documents(parsed, ["event_id", "k"], ["event_id", "event_type", "k"])


@query("split_lists", """WITH p AS (SELECT c_custkey, row_number() OVER (ORDER BY md5('42:' || c_custkey), c_custkey) - 1 AS pos,
    count(*) OVER () AS n FROM customer)
  SELECT CAST(c_custkey AS VARCHAR) AS name, CASE WHEN pos < floor(n * 0.7::DOUBLE) THEN 'train'
    WHEN pos < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM p""")
def split_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits = ordering.subject_split(B.table(spark, sf_dir, "customer"), "c_custkey")
    where = new_location(spark, "splits")
    stores.write_split_lists(splits, where, "c_custkey")
    return stores.read_split_lists(spark, where)


SHARDS = 7
SHARD_SQL = f"""placed AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position,
    ntile({SHARDS}) OVER (ORDER BY doc_id) - 1 AS shard FROM documents)"""


@query("shard_assign", f"""WITH {SHARD_SQL}
  SELECT doc_id, CAST(position AS BIGINT) AS position, CAST(shard AS BIGINT) AS shard FROM placed""")
def shard_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.shard_assign(B.table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], SHARDS)


@query("shard_manifest", f"""WITH {SHARD_SQL}, every AS (SELECT unnest(range(0, {SHARDS})) AS shard)
  SELECT CAST(e.shard AS BIGINT) AS shard, count(p.doc_id) OVER (PARTITION BY e.shard) AS num_files,
         p.doc_id AS file, p.position - min(p.position) OVER (PARTITION BY e.shard) AS place
  FROM every e LEFT JOIN placed p ON p.shard = e.shard""")
def shard_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = ordering.shard_assign(B.table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], SHARDS)
    pages = ordering.shard_manifest(assigned, "doc_id", SHARDS)
    start = assigned.groupBy("shard").agg(F.min("position").alias("_start"))
    files = scale.attach(pages, start, ["shard"], ["page"], "left").select(
        "shard", "num_files", "page", "_start", F.posexplode_outer("files").alias("i", "file")
    )
    # The first page of a shard may begin inside the shard's own range of positions.
    place = F.greatest(F.col("page") * 1000, F.col("_start")) + F.col("i") - F.col("_start")
    return files.select("shard", "num_files", F.col("file").cast("long").alias("file"), place.alias("place"))


@query("shard_copy", f"""WITH {SHARD_SQL}
  SELECT CAST(p.shard AS BIGINT) AS shard, count(*) AS num_files, CAST(sum(length(text)) AS BIGINT) AS n_chars
  FROM placed p JOIN documents d USING (doc_id) GROUP BY p.shard""")
def shard_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "text")
    where = new_location(spark, "shards")
    stores.write_shards(ordering.shard_assign(docs, ["doc_id"], SHARDS), where)
    back = spark.read.parquet(where)
    return back.groupBy(F.col("shard").cast("long").alias("shard")).agg(
        F.count(F.lit(1)).alias("num_files"), F.sum(F.length("text")).alias("n_chars")
    )


# Projections and predicates ---------------------------------------------------------------------


@query("subject_of", f"""WITH {LISTING_SQL} SELECT page_id, replace(rel, '/', '_') AS utterance,
  split_part(replace(rel, '/', '_'), '_', 1) AS subject FROM listing""")
def subject_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = page_listing(spark, sf_dir).withColumn("utterance", F.replace(F.col("rel"), F.lit("/"), F.lit("_")))
    return named.select("page_id", "utterance", C.subject_of(F.col("utterance")).alias("subject"))


def feature_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.when(F.col("page_id") % 3 == 0, "_mel.npy").when(F.col("page_id") % 3 == 1, "_params.npy").otherwise(".txt")
    return page_listing(spark, sf_dir).select("page_id", F.concat(F.lit("data/"), F.col("rel"), ending).alias("path"))


PATHS_SQL = f"""{LISTING_SQL}, paths AS (
  SELECT page_id, 'data/' || rel || CASE page_id % 3 WHEN 0 THEN '_mel.npy' WHEN 1 THEN '_params.npy' ELSE '.txt' END AS path
  FROM listing),
named AS (SELECT page_id, path, coalesce(nullif(regexp_extract(path, '([^/]+)_mel\\.npy$', 1), ''),
          nullif(regexp_extract(path, '([^/]+)_params\\.npy$', 1), '')) AS utterance FROM paths)"""


@query("utterance_name", f"""WITH {PATHS_SQL} SELECT page_id, utterance,
  regexp_replace(regexp_extract(path, '([^/]*)$', 1), '^(.+)\\.[^.]*$', '\\1') AS stem FROM named""")
def utterance_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return feature_paths(spark, sf_dir).select(
        "page_id", C.utterance_name(path).alias("utterance"), C.file_stem(path).alias("stem")
    )


@query("distinct_utterances", f"WITH {PATHS_SQL} SELECT DISTINCT utterance FROM named WHERE utterance IS NOT NULL")
def distinct_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.distinct_utterances(feature_paths(spark, sf_dir), "path")


@query("pattern_union", f"""WITH {LISTING_SQL}, every AS (
  SELECT rel AS path, '\\.mp4$' AS pattern FROM listing WHERE regexp_matches(rel, '\\.mp4$')
  UNION ALL SELECT rel, '\\.(avi|mov)$' FROM listing WHERE regexp_matches(rel, '\\.(avi|mov)$')
  UNION ALL SELECT rel, '^2drt/' FROM listing WHERE regexp_matches(rel, '^2drt/'))
  SELECT path, pattern FROM every""")
def pattern_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = page_listing(spark, sf_dir).select(F.col("rel").alias("path"))
    return selection.pattern_union(files, "path", [r"\.mp4$", r"\.(avi|mov)$", r"^2drt/"])


@query("fps_fallback", """WITH m AS (SELECT event_id, CASE WHEN event_type = 'click' THEN '{"fps": ' || json_extract(props, '$.k') || '}'
    WHEN event_type = 'view' THEN '{"frame_rate": "' || json_extract(props, '$.k') || '"}' ELSE props END AS meta FROM events)
  SELECT event_id, coalesce(try_cast(json_extract_string(meta, '$.fps') AS DOUBLE),
    try_cast(json_extract_string(meta, '$.frame_rate') AS DOUBLE), CAST(83.28 AS DOUBLE)) AS fps FROM m""")
def fps_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    meta = (
        F.when(F.col("event_type") == "click", F.concat(F.lit('{"fps": '), k, F.lit("}")))
        .when(F.col("event_type") == "view", F.concat(F.lit('{"frame_rate": "'), k, F.lit('"}')))
        .otherwise(F.col("props"))
    )
    return B.table(spark, sf_dir, "events").select("event_id", C.fps_fallback(meta).alias("fps"))


@query("alignment_valid", f"""WITH {B.SCORES_SQL}, v AS (SELECT *, n_frames / CAST(83.28 AS DOUBLE) * 0.5 AS half FROM scores)
  SELECT utt, correlation >= 0.3 AND abs(offset_seconds) <= half AS is_valid,
    CASE WHEN correlation < 0.3 THEN 'Low correlation: ' || printf('%.3f', correlation) || ' < 0.3'
         WHEN abs(offset_seconds) > half THEN 'Large offset: ' || printf('%.2f', abs(offset_seconds)) || 's (>' || printf('%.2f', half) || 's)'
         ELSE 'Valid alignment: correlation=' || printf('%.3f', correlation) END AS message
  FROM v""")
def alignment_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.validate_alignment(B.scores(spark, sf_dir), 0.3).select("utt", "is_valid", "message")


@query("quality_tier", f"WITH {B.SCORES_SQL} SELECT utt, {B.TIER_SQL} AS tier FROM scores")
def quality_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.scores(spark, sf_dir).select("utt", C.quality_tier(F.col("correlation")).alias("tier"))


@query("nan_alignment", f"""WITH {B.SCORES_SQL}, v AS (SELECT *, utt % 11 = 0 AS lost, n_frames / CAST(83.28 AS DOUBLE) * 0.5 AS half FROM scores)
  SELECT utt, NOT lost AND correlation >= 0.3 AND abs(offset_seconds) <= half AS is_valid, CASE WHEN lost THEN 'POOR' ELSE {B.TIER_SQL} END AS tier,
    CASE WHEN lost THEN 'Not finite' WHEN correlation < 0.3 THEN 'Low correlation: ' || printf('%.3f', correlation) || ' < 0.3'
         WHEN abs(offset_seconds) > half THEN 'Large offset: ' || printf('%.2f', abs(offset_seconds)) || 's (>' || printf('%.2f', half) || 's)'
         ELSE 'Valid alignment: correlation=' || printf('%.3f', correlation) END AS message
  FROM v""")
def nan_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgement and tier where some correlations are not a number."""
    correlation = F.when(F.col("utt") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("correlation"))
    judged = selection.validate_alignment(B.scores(spark, sf_dir).withColumn("correlation", correlation), 0.3)
    return judged.select("utt", "is_valid", C.quality_tier(F.col("correlation")).alias("tier"), "message")


SUBJECT_QUALITY_SQL = """subjects AS (SELECT DISTINCT source AS subject FROM documents),
quality AS (SELECT source AS subject, CAST(3 + count(*) FILTER (quality = 1) * 2 // greatest(count(*), 1) AS BIGINT) AS video_snr,
    CAST(5 - count(*) FILTER (toxic = 1) * 4 // greatest(count(*), 1) AS BIGINT) AS audio_snr, avg(quality) AS quality_score
  FROM documents JOIN labels USING (doc_id) GROUP BY source)"""


@query("subject_selection", f"""WITH {SUBJECT_QUALITY_SQL}
  SELECT 'all' AS mode, subject FROM subjects
  UNION ALL SELECT 'explicit', subject FROM subjects WHERE subject IN ('src1', 'src3', 'src5')
  UNION ALL SELECT 'recommended', subject FROM subjects WHERE subject IN (SELECT subject FROM quality
    WHERE video_snr >= 4 AND audio_snr >= 4 AND quality_score IS NOT NULL)""")
def subject_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = B.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("subject"))
    subjects = docs.select("subject").distinct()
    n = F.count(F.lit(1))
    quality = docs.join(B.table(spark, sf_dir, "labels"), "doc_id").groupBy("subject").agg(
        (F.floor(F.count_if(F.col("quality") == 1) * 2 / n) + 3).alias("video_snr"),
        (5 - F.floor(F.count_if(F.col("toxic") == 1) * 4 / n)).alias("audio_snr"),
        F.avg("quality").alias("quality_score"),
    )
    parts = [
        selection.select_subjects(subjects, mode, ids=["src1", "src3", "src5"], quality=quality).select(
            F.lit(mode).alias("mode"), "subject"
        )
        for mode in ("all", "explicit", "recommended")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Joins ------------------------------------------------------------------------------------------


@query("pair_utterances", "SELECT doc_id, source, quality, toxic FROM documents JOIN labels USING (doc_id)")
def pair_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "source")
    return selection.pair_utterances(docs, B.table(spark, sf_dir, "labels"), "doc_id")


@query("unpaired_utterances", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unpaired_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "source")
    return selection.unpaired_utterances(docs, B.table(spark, sf_dir, "labels"), "doc_id")


def order_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature frames of an order: one to seven of them, so that some counts differ from the lines."""
    orders = B.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return orders.select(
        F.col("o_orderkey").alias("utt"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("o_orderkey") % 7)).alias("frame_idx"),
        "o_totalprice",
    ).withColumn("feature", F.col("o_totalprice") / (F.col("frame_idx") + 1)).drop("o_totalprice")


FEATURES_SQL = """features AS (SELECT o_orderkey AS utt, i AS frame_idx, o_totalprice / (i + 1) AS feature
  FROM (SELECT o_orderkey, o_totalprice, unnest(range(0, o_orderkey % 7 + 1)) AS i FROM orders))"""
MISMATCH_SQL = """mismatch AS (SELECT utt, a.n AS n_features, b.n AS n_params
  FROM (SELECT utt, count(*) AS n FROM features GROUP BY utt) a
  JOIN (SELECT utt, count(*) AS n FROM parameters GROUP BY utt) b USING (utt) WHERE a.n <> b.n)"""


@query("feature_param_join", f"""WITH {FEATURES_SQL}, {B.PARAMETERS_SQL}, {MISMATCH_SQL}
  SELECT utt, CAST(frame_idx AS BIGINT) AS frame_idx, {d6('feature')} AS feature, l_quantity, l_extendedprice
  FROM features JOIN parameters USING (utt, frame_idx) WHERE utt NOT IN (SELECT utt FROM mismatch)""")
def feature_param_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = B.parameters(spark, sf_dir).select("utt", "frame_idx", "l_quantity", "l_extendedprice")
    joined = selection.feature_param_join(order_features(spark, sf_dir), params)
    return joined.withColumn("feature", C.r6(F.col("feature")))


@query("frame_count_mismatch", f"WITH {FEATURES_SQL}, {B.PARAMETERS_SQL}, {MISMATCH_SQL} SELECT * FROM mismatch")
def frame_count_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = B.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("utt"))
    return selection.frame_count_mismatch(order_features(spark, sf_dir), lines)


SUBJECT_SPLIT_SQL = """placed AS (SELECT c_custkey AS subject, row_number() OVER (ORDER BY md5('42:' || c_custkey), c_custkey) - 1 AS pos,
  count(*) OVER () AS n FROM customer),
splits AS (SELECT subject, CASE WHEN pos < floor(n * 0.7::DOUBLE) THEN 'train'
  WHEN pos < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM placed)"""


SPLIT_PAGE = 1000


def customer_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject"))
    return ordering.subject_split(customers, "subject")


def split_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every utterance with the split of its subject."""
    utts = B.scores(spark, sf_dir).select("utt", "subject")
    return scale.attach(utts, customer_split(spark, sf_dir), ["subject"], ["utt"])


@query("subject_split", f"""WITH {SUBJECT_SPLIT_SQL}
  SELECT o_orderkey AS utt, subject, split FROM splits JOIN orders ON o_custkey = subject""")
def subject_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_utterances(spark, sf_dir)


@query("split_membership", f"""WITH {SUBJECT_SPLIT_SQL}
  SELECT o_orderkey AS utt, o_custkey AS subject FROM orders WHERE o_custkey IN (SELECT subject FROM splits WHERE split = 'val')""")
def split_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    utts = B.scores(spark, sf_dir).select("utt", "subject")
    return selection.split_membership(utts, customer_split(spark, sf_dir), "val", "subject", ["utt"])


@query("label_dir_split", """WITH placed AS (SELECT c_custkey, row_number() OVER (ORDER BY md5('42:' || c_custkey), c_custkey) - 1 AS pos,
    count(*) OVER () AS n FROM customer),
  cut AS (SELECT c_custkey, pos, n - floor(n * 0.15::DOUBLE) - floor(n * 0.2::DOUBLE) AS a, floor(n * 0.15::DOUBLE) AS v FROM placed)
  SELECT c_custkey, CASE WHEN pos < a THEN 'train' WHEN pos < a + v THEN 'val' ELSE 'test' END AS split FROM cut""")
def label_dir_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.label_dir_split(B.table(spark, sf_dir, "customer"), "c_custkey", 0.15, 0.2)


@query("ordered_split", """WITH placed AS (SELECT doc_id, row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) - 1 AS pos,
    count(*) OVER () AS n FROM documents)
  SELECT CAST(doc_id AS VARCHAR) AS name, CASE WHEN pos < floor(n * 0.8::DOUBLE) THEN 'train'
    WHEN pos < floor(n * 0.9::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM placed""")
def ordered_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = B.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"))
    return ordering.ordered_split(names, "name")


@query("split_disjoint", f"""WITH {SUBJECT_SPLIT_SQL}
  SELECT count(*) AS n_leaks FROM (SELECT o_custkey FROM orders JOIN splits ON o_custkey = subject
    GROUP BY o_custkey HAVING count(DISTINCT split) > 1)""")
def split_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    utts = split_utterances(spark, sf_dir)
    return ordering.split_leaks(utts, "subject").agg(F.count(F.lit(1)).alias("n_leaks"))


@query("split_info", f"""WITH {SUBJECT_SPLIT_SQL}, held AS (SELECT split, o_custkey, o_orderkey FROM orders JOIN splits ON o_custkey = subject),
  per AS (SELECT split, count(DISTINCT o_custkey) AS s, count(*) AS u, min(o_custkey) AS lo, max(o_custkey) AS hi FROM held GROUP BY split),
  info AS (SELECT split, coalesce(s, 0) AS num_subjects, coalesce(u, 0) AS num_utterances, lo AS first_subject, hi AS last_subject,
    CAST(sum(s) OVER () AS BIGINT) AS total_subjects, CAST(sum(u) OVER () AS BIGINT) AS total_utterances,
    CAST(CASE split WHEN 'train' THEN 0.7 ELSE 0.15 END AS DOUBLE) AS asked_ratio, {d6('coalesce(s, 0) / sum(s) OVER ()')} AS actual_ratio
    FROM (VALUES ('train'), ('val'), ('test')) asked(split) LEFT JOIN per USING (split)),
  listed AS (SELECT split, 'subject' AS member, row_number() OVER (PARTITION BY split ORDER BY o_custkey) - 1 AS place, o_custkey AS name
    FROM (SELECT DISTINCT split, o_custkey FROM held)
    UNION ALL SELECT split, 'utterance', row_number() OVER (PARTITION BY split ORDER BY o_orderkey) - 1, o_orderkey FROM held)
  SELECT info.*, member, place, name FROM info LEFT JOIN listed USING (split) WHERE total_subjects > 0""")
def split_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    utts = split_utterances(spark, sf_dir)
    pages = summaries.split_info(utts, "subject", "utt", {"train": 0.7, "val": 0.15, "test": 0.15}, SPLIT_PAGE)
    listed = lambda member, names: F.transform(
        names, lambda name, i: F.struct(F.lit(member).alias("member"), (F.col("page") * SPLIT_PAGE + i).alias("place"), name.alias("name"))
    )
    # A split without names keeps its row.
    rows = pages.withColumn("_m", F.explode_outer(F.concat(listed("subject", "subjects"), listed("utterance", "utterances"))))
    return rows.select("*", "_m.*").drop("_m", "page", "subjects", "utterances").withColumn("actual_ratio", C.r6(F.col("actual_ratio")))


@query("split_members", f"""WITH {SUBJECT_SPLIT_SQL}, s AS (SELECT DISTINCT split, subject FROM orders JOIN splits ON o_custkey = subject)
  SELECT split, row_number() OVER (PARTITION BY split ORDER BY subject) - 1 AS place, subject FROM s""")
def split_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = summaries.split_members(split_utterances(spark, sf_dir), "subject", 100)
    rows = pages.select("split", "page", F.posexplode("subjects").alias("i", "subject"))
    return rows.select("split", (F.col("page") * 100 + F.col("i")).alias("place"), "subject")


def expected_and_done(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    scores = B.scores(spark, sf_dir)
    expected = scores.groupBy("subject").agg(F.count(F.lit(1)).alias("n_expected"))
    done = scores.where("status = 'F'").groupBy("subject").agg(F.count(F.lit(1)).alias("n_done"))
    return expected, done


DONE_SQL = f"""{B.SCORES_SQL}, expected AS (SELECT subject, count(*) AS n_expected FROM scores GROUP BY subject),
done AS (SELECT subject, count(*) AS n_done FROM scores WHERE status = 'F' GROUP BY subject)"""


@query("expected_vs_done", f"""WITH {DONE_SQL}
  SELECT subject, n_expected, coalesce(n_done, 0) AS n_done FROM expected LEFT JOIN done USING (subject)""")
def expected_vs_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.expected_vs_done(*expected_and_done(spark, sf_dir), "subject")


@query("remaining_subjects", f"WITH {DONE_SQL} SELECT subject FROM expected EXCEPT SELECT subject FROM done")
def remaining_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.remaining(*expected_and_done(spark, sf_dir), "subject")


# Summaries --------------------------------------------------------------------------------------


@query("corpus_stats", """SELECT lang AS format, count(DISTINCT source) AS n_subjects, count(*) AS n_rows, count(l.doc_id) AS n_with_metadata
  FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ROLLUP (lang)""")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "source", F.col("lang").alias("format"))
    marks = B.table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("has"))
    return summaries.corpus_stats(docs.join(marks, "doc_id", "left"), "source", "format", F.col("has").isNotNull())


@query("utts_per_subject", f"""WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)
  SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS n_subjects, {d6('avg(n)')} AS mean, {d6('stddev_pop(n)')} AS std,
    min(n) AS least, max(n) AS most FROM c""")
def utts_per_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summaries.utterances_per_subject(B.scores(spark, sf_dir), "subject")
    return out.withColumn("mean", C.r6(F.col("mean"))).withColumn("std", C.r6(F.col("std")))


@query("fps_distribution", f"""WITH f AS (SELECT CAST(json_extract(props, '$.k') AS DOUBLE) AS fps FROM events WHERE event_type <> 'error')
  SELECT count(*) AS n_known, min(fps) AS least, max(fps) AS most, {d6('avg(fps)')} AS mean, {d6('quantile_cont(fps, 0.5)')} AS median FROM f""")
def fps_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.when(F.col("event_type") != "error", F.get_json_object("props", "$.k").cast("double"))
    out = summaries.fps_distribution(B.table(spark, sf_dir, "events").select(known.alias("fps")), "fps")
    return out.withColumn("mean", C.r6(F.col("mean"))).withColumn("median", C.r6(F.col("median")))


@query("batch_rollup", f"""WITH {B.SCORES_SQL}
  SELECT subject, grouping_id(subject) AS level, count(*) AS total, count(*) FILTER (status <> 'P') AS processed,
    count(*) FILTER (status = 'P') AS failed, {d6("count(*) FILTER (status <> 'P') / count(*)")} AS success_rate
  FROM scores GROUP BY ROLLUP (subject)""")
def batch_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summaries.batch_rollup(B.scores(spark, sf_dir), "subject", F.col("status") != "P")
    return out.withColumn("success_rate", C.r6(F.col("success_rate")))


@query("corr_distribution", f"""WITH {B.SCORES_SQL}
  SELECT count(correlation) AS n, {d6('avg(correlation)')} AS mean, {d6('stddev_pop(correlation)')} AS std,
    {d6('stddev_samp(correlation)')} AS std_sample, {d6('min(correlation)')} AS least, {d6('max(correlation)')} AS most,
    count(*) FILTER (correlation >= 0.3) AS n_good, {d6('quantile_cont(correlation, 0.1)')} AS p10,
    {d6('quantile_cont(correlation, 0.25)')} AS p25, {d6('quantile_cont(correlation, 0.5)')} AS median,
    {d6('quantile_cont(correlation, 0.75)')} AS p75, {d6('quantile_cont(correlation, 0.9)')} AS p90,
    {d6('count(*) FILTER (correlation >= 0.3) / count(correlation)')} AS share_good FROM scores""")
def corr_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summaries.correlation_distribution(B.scores(spark, sf_dir), "correlation")
    whole = ("n", "n_good")
    return out.select(*[F.col(c) if c in whole else C.r6(F.col(c)).alias(c) for c in out.columns])


@query("tier_counts", f"WITH {B.SCORES_SQL} SELECT {B.TIER_SQL} AS tier, count(*) AS n FROM scores GROUP BY 1")
def tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.tier_counts(B.scores(spark, sf_dir), "correlation")


@query("histogram", f"""WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
  c AS (SELECT least(floor((value - lo) / (hi - lo) * 50), 49) AS bin, count(*) AS n FROM events, e GROUP BY 1)
  SELECT b.bin, {d6('lo + b.bin * ((hi - lo) / 50)')} AS low_edge, coalesce(n, 0) AS n
  FROM (SELECT unnest(range(0, 50)) AS bin) b LEFT JOIN c ON c.bin = b.bin, e""")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summaries.histogram(B.table(spark, sf_dir, "events"), "value", 50)
    return out.withColumn("low_edge", C.r6(F.col("low_edge")))


@query("signal_stats", f"""SELECT user_id AS utt, count(value) AS n, {d6('count(value) / 83.28::DOUBLE')} AS duration, min(value) AS least,
  max(value) AS most, {d6('avg(value)')} AS mean, {d6('stddev_pop(value)')} AS std, {d6('sqrt(avg(value * value))')} AS rms,
  count(value) * 4 AS n_bytes FROM events GROUP BY user_id""")
def signal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summaries.signal_stats(B.table(spark, sf_dir, "events").withColumnRenamed("user_id", "utt"), ["utt"], "value", 83.28)
    rounded = ("duration", "mean", "std", "rms")
    return out.select(*[C.r6(F.col(c)).alias(c) if c in rounded else F.col(c) for c in out.columns])


@query("finite_check", """WITH s AS (SELECT user_id AS utt, CASE WHEN event_id % 997 = 0 THEN CAST('nan' AS DOUBLE)
    WHEN event_id % 1499 = 0 THEN CAST('inf' AS DOUBLE) ELSE value END AS v FROM events)
  SELECT utt, bool_or(isnan(v)) AS has_nan, bool_or(isinf(v)) AS has_inf FROM s GROUP BY utt""")
def finite_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    spoiled = (
        F.when(F.col("event_id") % 997 == 0, F.lit(float("nan")))
        .when(F.col("event_id") % 1499 == 0, F.lit(float("inf")))
        .otherwise(F.col("value"))
    )
    events = B.table(spark, sf_dir, "events").select(F.col("user_id").alias("utt"), spoiled.alias("v"))
    return selection.finite_check(events, ["utt"], "v")


@query("duration_check", """SELECT user_id AS utt, abs(count(*) / 83.28::DOUBLE - count(*) FILTER (event_type <> 'error') / 70.0::DOUBLE) < 1.0 AS matches
  FROM events GROUP BY user_id""")
def duration_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = B.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("utt")).agg(
        F.count(F.lit(1)).alias("t"), F.count_if(F.col("event_type") != "error").alias("n")
    )
    return events.select("utt", C.duration_matches(F.col("t"), F.lit(83.28), F.col("n"), F.lit(70.0)).alias("matches"))


@query("distinct_values", """SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS sample_rate, count(*) AS n, min(event_id) AS first_at
  FROM events GROUP BY 1""")
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.get_json_object("props", "$.k").cast("long").alias("sample_rate")
    events = B.table(spark, sf_dir, "events").select("event_id", rate)
    return summaries.distinct_values(events, "sample_rate", F.col("event_id"))


@query("typical_sample", f"""WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)
  SELECT (SELECT event_type FROM events ORDER BY event_id LIMIT 1) AS typical, {d6('avg(n)')} AS mean_frames,
    {d6('avg(n) / 83.28::DOUBLE')} AS mean_duration, count(*) AS n_samples FROM c""")
def typical_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summaries.typical_sample(B.table(spark, sf_dir, "events"), ["user_id"], "event_type", F.col("event_id"), 83.28)
    return out.withColumn("mean_frames", C.r6(F.col("mean_frames"))).withColumn("mean_duration", C.r6(F.col("mean_duration")))


@query("demographics", """SELECT 'lang' AS attribute, lang AS value, count(*) AS n FROM documents GROUP BY lang
  UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source""")
def demographics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.demographics(B.table(spark, sf_dir, "documents").select("lang", "source"), ["lang", "source"])


@query("progress_eta", f"""WITH {B.SCORES_SQL}, t AS (SELECT count(*) AS expected, count(*) FILTER (status = 'F') AS done FROM scores)
  SELECT expected, done, {d6('done / expected * 100')} AS percent, {d6('(expected - done) * 3.5::DOUBLE / 60')} AS eta_minutes FROM t""")
def progress_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summaries.progress(B.scores(spark, sf_dir), (F.col("status") == "F").cast("long"), F.lit(1))
    return out.withColumn("percent", C.r6(F.col("percent"))).withColumn("eta_minutes", C.r6(F.col("eta_minutes")))


# Ranks ------------------------------------------------------------------------------------------


@query("best_per_subject", f"""WITH {B.SCORES_SQL} SELECT subject, utt, {d6('correlation')} AS correlation FROM
  (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY coalesce(correlation, 0) DESC, utt) AS r FROM scores) WHERE r = 1""")
def best_per_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = ordering.best_per_subject(B.scores(spark, sf_dir).select("subject", "utt", "correlation"), "subject", "utt", "correlation")
    return best.withColumn("correlation", C.r6(F.col("correlation")))


@query("top_n_per_subject", f"""WITH {B.SCORES_SQL} SELECT subject, utt, r AS rank FROM
  (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY correlation DESC, utt) AS r FROM scores) WHERE r <= 10""")
def top_n_per_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = B.scores(spark, sf_dir).select("subject", "utt", "correlation")
    return ordering.top_n(scores, ["subject"], [F.col("correlation").desc(), F.col("utt")], 10).drop("correlation")


@query("first_n_per_group", f"""WITH {B.SCORES_SQL}, firsts AS (SELECT DISTINCT subject FROM scores ORDER BY subject LIMIT 100)
  SELECT subject, utt, r AS rank FROM
  (SELECT subject, utt, row_number() OVER (PARTITION BY subject ORDER BY utt) AS r FROM scores WHERE subject IN (SELECT subject FROM firsts)) WHERE r <= 3""")
def first_n_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = ordering.first_subjects(B.scores(spark, sf_dir).select("subject", "utt"), "subject", 100)
    return ordering.top_n(scores, ["subject"], [F.col("utt")], 3)


@query("rank_best_worst", f"""WITH {B.SCORES_SQL}
  SELECT utt, {d6('correlation')} AS correlation, kind FROM (
    (SELECT utt, correlation, 'best' AS kind FROM scores ORDER BY correlation DESC, utt LIMIT 5)
    UNION ALL (SELECT utt, correlation, 'worst' FROM scores ORDER BY correlation, utt DESC LIMIT 5))""")
def rank_best_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ordering.rank_best_worst(B.scores(spark, sf_dir).select("utt", "correlation"), "correlation", "utt", 5)
    return out.withColumn("correlation", C.r6(F.col("correlation")))


@query("tier_representatives", f"""WITH {B.SCORES_SQL}, banded AS (SELECT utt, correlation, CASE WHEN correlation >= 0.3 THEN 'GOOD'
    WHEN correlation >= 0.2 THEN 'MODERATE' WHEN correlation >= 0.1 THEN 'ACCEPTABLE' ELSE 'POOR' END AS kind FROM scores),
  placed AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY correlation DESC, utt) - 1 AS pos, count(*) OVER (PARTITION BY kind) AS n FROM banded)
  SELECT kind, utt, {d6('correlation')} AS correlation FROM (
    SELECT kind, utt, correlation FROM placed WHERE (kind <> 'GOOD' OR n > 1) AND pos = CASE WHEN kind = 'POOR' THEN 0 ELSE n // 2 END
    UNION ALL (SELECT 'BEST', utt, correlation FROM scores ORDER BY correlation DESC, utt LIMIT 1)
    UNION ALL (SELECT 'WORST', utt, correlation FROM scores ORDER BY correlation, utt DESC LIMIT 1))""")
def tier_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ordering.tier_representatives(B.scores(spark, sf_dir), "utt", "correlation")
    return out.withColumn("correlation", C.r6(F.col("correlation")))


NAN_SQL = f"{B.SCORES_SQL}, odd AS (SELECT subject, utt, CASE WHEN utt % 3 = 0 THEN 'NaN'::DOUBLE ELSE correlation END AS c FROM scores)"


@query("nan_ranking", f"""WITH {NAN_SQL}, banded AS (SELECT utt, c, CASE WHEN isnan(c) THEN 'POOR' WHEN c >= 0.3 THEN 'GOOD' WHEN c >= 0.2 THEN 'MODERATE' WHEN c >= 0.1 THEN 'ACCEPTABLE' ELSE 'POOR' END AS kind FROM odd),
  placed AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY isnan(c), c DESC, utt) - 1 AS pos, count(*) OVER (PARTITION BY kind) AS n FROM banded),
  found AS (SELECT 'of subject' AS kind, utt, c FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY isnan(c), c DESC, utt) AS r FROM odd) WHERE r = 1
    UNION ALL SELECT kind, utt, c FROM placed WHERE (kind <> 'GOOD' OR n > 1) AND pos = CASE WHEN kind = 'POOR' THEN 0 ELSE n // 2 END
    UNION ALL (SELECT 'BEST', utt, c FROM odd ORDER BY isnan(c), c DESC, utt LIMIT 1) UNION ALL (SELECT 'WORST', utt, c FROM odd ORDER BY isnan(c), c, utt DESC LIMIT 1))
  SELECT kind, utt, isnan(c) AS is_nan, {d6('CASE WHEN isnan(c) THEN 0 ELSE c END')} AS correlation FROM found""")
def nan_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best of each subject, tier representatives, best and worst where a third of the correlations is NaN."""
    odd = B.scores(spark, sf_dir).withColumn("correlation", F.when(F.col("utt") % 3 == 0, float("nan")).otherwise(F.col("correlation")))
    best = ordering.best_per_subject(odd.select("subject", "utt", "correlation"), "subject", "utt", "correlation")
    found = best.select(F.lit("of subject").alias("kind"), "utt", "correlation").unionByName(ordering.tier_representatives(odd, "utt", "correlation"))
    return found.select("kind", "utt", F.isnan("correlation").alias("is_nan"), C.r6(F.nanvl("correlation", F.lit(0.0))).alias("correlation"))


@query("ecdf", f"""WITH {B.SCORES_SQL} SELECT utt, {d6('correlation')} AS correlation,
  {d6('row_number() OVER (ORDER BY correlation, utt) / count(*) OVER () * 100')} AS percent FROM scores""")
def ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ordering.ecdf(B.scores(spark, sf_dir), "correlation", "utt")
    return out.select("utt", C.r6(F.col("correlation")).alias("correlation"), C.r6(F.col("percent")).alias("percent"))


# Parameters -------------------------------------------------------------------------------------

PARAMS = ["l_quantity", "l_extendedprice", "l_discount"]


@query("norm_stats", "SELECT " + ", ".join(
    f"{d6(f'avg({p})')} AS mean_{p}, {d6(f'CASE WHEN stddev_pop({p}) < 1e-8 THEN 1 ELSE stddev_pop({p}) END')} AS std_{p}" for p in PARAMS
) + " FROM lineitem")
def norm_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summaries.norm_stats(B.table(spark, sf_dir, "lineitem"), PARAMS)
    return out.select(*[C.r6(F.col(c)).alias(c) for c in out.columns])


@query("norm_stats_sampled", f"""WITH firsts AS (SELECT DISTINCT conv_id FROM conversations ORDER BY conv_id LIMIT 100),
  s AS (SELECT CAST(length(text) AS DOUBLE) AS n_chars, CAST(turn AS DOUBLE) AS turn FROM conversations WHERE conv_id IN (SELECT conv_id FROM firsts))
  SELECT {d6('avg(n_chars)')} AS mean_n_chars, {d6('avg(turn)')} AS mean_turn,
    {d6('CASE WHEN stddev_pop(n_chars) < 1e-8 THEN 1 ELSE stddev_pop(n_chars) END')} AS std_n_chars,
    {d6('CASE WHEN stddev_pop(turn) < 1e-8 THEN 1 ELSE stddev_pop(turn) END')} AS std_turn FROM s""")
def norm_stats_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = B.table(spark, sf_dir, "conversations").select("conv_id", F.length("text").alias("n_chars"), "turn")
    out = summaries.norm_stats_sampled(conv, "conv_id", ["n_chars", "turn"], 100)
    return out.select(*[C.r6(F.col(c)).alias(c) for c in out.columns])


@query("standardize", f"""WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_extendedprice) AS mp, stddev_pop(l_extendedprice) AS sp FROM lineitem)
  SELECT l_orderkey, l_linenumber, {d6('(l_quantity - mq) / sq')} AS l_quantity_z, {d6('(l_extendedprice - mp) / sp')} AS l_extendedprice_z,
    {d6('l_quantity')} AS l_quantity_back, {d6('l_extendedprice')} AS l_extendedprice_back FROM lineitem, s""")
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["l_quantity", "l_extendedprice"]
    lines = B.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *names)
    stats = summaries.norm_stats(lines, names)
    both = summaries.denormalize(summaries.standardize(lines, stats, names), stats, names)
    made = [f"{n}{s}" for s in ("_z", "_back") for n in names]
    return both.select("l_orderkey", "l_linenumber", *[C.r6(F.col(c)).alias(c) for c in made])


def param_pairs() -> dict[str, tuple[Column, Column]]:
    q, p = F.col("l_quantity"), F.col("l_extendedprice") / 1000
    return {"quantity": (q * (1 + F.col("l_discount")), q), "price": (p * (1 - F.col("l_tax")), p), "flat": (q * 0 + 2, q * 0 + 1)}


@query("regression_metrics", f"""WITH e AS (SELECT l_quantity * (1 + l_discount) AS p0, l_quantity AS t0,
    l_extendedprice / 1000 * (1 - l_tax) AS p1, l_extendedprice / 1000 AS t1 FROM lineitem WHERE l_returnflag <> 'R')
  SELECT count(*) AS n_frames, {d6('sqrt((avg((p0 - t0) ** 2) + avg((p1 - t1) ** 2) + 1) / 3)')} AS rmse,
    {d6('(avg(abs(p0 - t0)) + avg(abs(p1 - t1)) + 1) / 3')} AS mae, {d6('(corr(p0, t0) + corr(p1, t1)) / 2')} AS pearson FROM e""")
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summaries.regression_metrics(B.table(spark, sf_dir, "lineitem"), param_pairs(), F.col("l_returnflag") != "R")
    return out.select("n_frames", *[C.r6(F.col(c)).alias(c) for c in ("rmse", "mae", "pearson")])


@query("human_count", """SELECT l_partkey, count(*) AS n, CASE WHEN v >= 1000000 THEN printf('%.2f', v / 1000000) || 'M'
    WHEN v >= 1000 THEN printf('%.2f', v / 1000) || 'K' ELSE CAST(CAST(v AS BIGINT) AS VARCHAR) END AS label
  FROM (SELECT l_partkey, CAST(sum(l_quantity) * l_partkey AS BIGINT) AS v0, CAST(v0 AS DOUBLE) AS v, count(*) AS c
        FROM lineitem GROUP BY l_partkey) t JOIN lineitem USING (l_partkey) GROUP BY l_partkey, v""")
def human_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = B.table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("n"), (F.sum("l_quantity") * F.col("l_partkey")).cast("long").alias("v")
    )
    return sums.select("l_partkey", "n", C.human_count(F.col("v")).alias("label"))


# Ragged sequences -------------------------------------------------------------------------------


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = B.table(spark, sf_dir, "conversations")
    return conv.select(
        F.col("conv_id").alias("utt"), F.col("turn").alias("frame_idx"), F.length("text").cast("double").alias("value"), "role"
    )


@query("masked_mean", f"""SELECT conv_id AS utt, {d6("sum(CASE WHEN role = 'user' THEN 0 ELSE length(text) END) / greatest(count(*) FILTER (role <> 'user'), 1e-9)")} AS masked_mean
  FROM conversations GROUP BY conv_id""")
def masked_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summaries.masked_mean(turns(spark, sf_dir), ["utt"], F.col("value"), F.col("role") == "user")
    return out.withColumn("masked_mean", C.r6(F.col("masked_mean")))


@query("masked_mse", f"""WITH p AS (SELECT conv_id, count(*) AS n, sum(CASE WHEN role = 'user' THEN 0 ELSE (length(text) - 100.0 * turn) ** 2 END) AS e
    FROM conversations GROUP BY conv_id)
  SELECT count(*) AS n_sequences, max(n) AS longest, {d6('sum(e) / (count(*) * max(n))')} AS masked_mse FROM p""")
def masked_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = turns(spark, sf_dir)
    out = summaries.masked_mse(df, "utt", F.col("value"), F.col("frame_idx") * 100.0, F.col("role") == "user")
    return out.withColumn("masked_mse", C.r6(F.col("masked_mse")))


BATCH = 8


@query("pad_collate", f"""WITH s AS (SELECT conv_id AS utt, count(*) AS length, (row_number() OVER (ORDER BY conv_id) - 1) // {BATCH} AS batch
    FROM conversations GROUP BY conv_id),
  p AS (SELECT *, max(length) OVER (PARTITION BY batch) AS longest FROM s),
  g AS (SELECT *, unnest(range(0, longest)) AS frame_idx FROM p)
  SELECT g.utt, CAST(g.frame_idx AS BIGINT) AS frame_idx, CAST(coalesce(length(c.text), 0) AS DOUBLE) AS value, g.length,
    CAST(g.batch AS BIGINT) AS batch, g.longest, g.frame_idx >= g.length AS is_pad
  FROM g LEFT JOIN conversations c ON c.conv_id = g.utt AND c.turn = g.frame_idx""")
def pad_collate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.pad_collate(turns(spark, sf_dir), "utt", "frame_idx", "value", BATCH)


@query("sequence_chunks", """WITH s AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
  SELECT conv_id AS utt, turn AS frame_idx, CAST(length(text) AS DOUBLE) AS value, role, CAST(turn // 3 AS BIGINT) AS chunk,
    conv_id || '_seq' || (turn // 3) AS sequence, CAST(turn // 3 * 3 AS BIGINT) AS start_idx, CAST(turn // 3 * 3 + 3 AS BIGINT) AS end_idx
  FROM s WHERE turn // 3 < n // 3""")
def sequence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.sequence_chunks(turns(spark, sf_dir), "utt", "frame_idx", 3)
