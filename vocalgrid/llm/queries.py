"""The queries of the operators and of the pipeline, each over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from vocalgrid.llm import (
    chat_pairs, cross_align, decontaminate, fill_middle, html_text, jaccard_join, license_scan, personal_data, piece_codec, quality, sharding, token_counts, toxicity,
)
from vocalgrid.llm.common import ORACLES, QUERIES, query, table
from vocalgrid.llm.vocabulary import vocabulary

__all__ = ["ORACLES", "QUERIES"]

_TURN = "'<|im_start|>' || replace(coalesce(role, ''), '<|im_', '<| im_') || chr(10) || replace(coalesce(text, ''), '<|im_', '<| im_') || '<|im_end|>' || chr(10)"
_HEAD = "'<|im_start|>' || replace(coalesce(role, ''), '<|im_', '<| im_') || chr(10)"

_CHAT_SQL = f"""
WITH numbered AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations
), ends AS (
  SELECT conv_id, max(n) AS last FROM numbered WHERE role = 'assistant' GROUP BY conv_id
), chosen AS (
  SELECT c.* FROM numbered c JOIN ends USING (conv_id) WHERE n <= last
), stale AS (
  SELECT e.conv_id, e.last, coalesce(CASE WHEN p.n IS NOT NULL THEN p.text ELSE b.text END, '') AS text
  FROM ends e
  LEFT JOIN (SELECT c.conv_id, max(n) AS n FROM chosen c JOIN ends USING (conv_id) WHERE role = 'assistant' AND n < last GROUP BY c.conv_id) q ON q.conv_id = e.conv_id
  LEFT JOIN numbered p ON p.conv_id = e.conv_id AND p.n = q.n
  LEFT JOIN numbered b ON b.conv_id = e.conv_id AND b.n = e.last - 1
), rejected AS (
  SELECT c.conv_id, c.role, c.text, c.n FROM chosen c JOIN ends USING (conv_id) WHERE n < last
  UNION ALL SELECT conv_id, 'assistant', text, last FROM stale
), common AS (
  SELECT c.conv_id, coalesce(min(CASE WHEN c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text THEN c.n END) - 1, max(c.n)) AS k
  FROM chosen c JOIN rejected r ON r.conv_id = c.conv_id AND r.n = c.n GROUP BY c.conv_id
), sides AS (
  SELECT 'c' AS side, * FROM chosen UNION ALL SELECT 'r', * FROM rejected
), cut AS (
  SELECT side, s.conv_id, n, k, role, {_TURN} AS made, {_HEAD} AS head FROM sides s JOIN common USING (conv_id)
), laid AS (
  SELECT *, coalesce(sum(length(made)) OVER (PARTITION BY side, conv_id, n > k ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM cut
)
SELECT conv_id, CAST(min(k) AS BIGINT) AS n_prompt_turns,
  coalesce(string_agg(made, '' ORDER BY n) FILTER (side = 'c' AND n <= k), '') AS prompt,
  coalesce(string_agg(made, '' ORDER BY n) FILTER (side = 'c' AND n > k), '') AS chosen,
  coalesce(string_agg(made, '' ORDER BY n) FILTER (side = 'r' AND n > k), '') AS rejected,
  coalesce(string_agg(CAST(CAST(begins + length(head) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(begins + length(made) - 1 AS BIGINT) AS VARCHAR), ',' ORDER BY n)
    FILTER (side = 'c' AND n > k AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(CAST(CAST(begins + length(head) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(begins + length(made) - 1 AS BIGINT) AS VARCHAR), ',' ORDER BY n)
    FILTER (side = 'r' AND n > k AND role = 'assistant'), '') AS rejected_mask
FROM laid GROUP BY conv_id
"""


@query("op1_preference_format", _CHAT_SQL)
def op1_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat_pairs.stale_answer_pairs(table(spark, sf_dir, "conversations"))
    made = chat_pairs.format_preferences(pairs)
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return made.select(
        "conv_id", F.col("n_prompt_turns").cast("long").alias("n_prompt_turns"), "prompt", "chosen", "rejected",
        shown("chosen_mask").alias("chosen_mask"), shown("rejected_mask").alias("rejected_mask"),
    )


@query("op2_jaccard_join")
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_windows")


@query("op5_license_scan")
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(table(spark, sf_dir, "documents"))


@query("op6_quality_rules")
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


@query("op7_html_text")
def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extracted(pages, html_text.fitted(pages))


@query("op8_sentencepiece")
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encoded(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@query("op9_decontaminate")
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_key")


@query("op10_shards")
def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.document_shards(table(spark, sf_dir, "documents"))


@query("op11_cross_align")
def op11_cross_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
    rows = cross_align.aligned(table(spark, sf_dir, "documents"), *paths)
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    made = cross_align.with_link_counts(rows.withColumn("groups_sha256", digest).drop("groups"), cross_align.sides(*paths).width)
    return made.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


_FILL_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents
), h AS (
  SELECT doc_id, t, string_split(t, chr(10)) AS parts,
    CAST('0x' || substr(s, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(s, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(s, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(s, 25, 8) AS BIGINT) AS h4 FROM d
), u AS (
  SELECT *, CAST(len(parts) - CASE WHEN parts[-1] = '' THEN 1 ELSE 0 END AS BIGINT) AS n,
    t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 AS plain FROM h
), k AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS k1, greatest(h1 % (n + 1), h2 % (n + 1)) AS k2 FROM u
), c AS (
  SELECT *, CASE WHEN k1 = 0 THEN 0 WHEN k1 = n THEN length(t) ELSE length(array_to_string(parts[1:k1], chr(10))) + 1 END AS a,
    CASE WHEN k2 = 0 THEN 0 WHEN k2 = n THEN length(t) ELSE length(array_to_string(parts[1:k2], chr(10))) + 1 END AS b FROM k
), o AS (
  SELECT *, CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
    substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c
)
SELECT doc_id, n, form, CAST(CASE WHEN NOT plain THEN a END AS BIGINT) AS prefix_chars, CAST(CASE WHEN NOT plain THEN b - a END AS BIGINT) AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM o
"""


@query("op12_fill_middle", _FILL_SQL)
def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


@query("op13_personal_data")
def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = personal_data.personal_spans(docs, personal_data.fitted(docs))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in personal_data.KINDS]
    return found.select("doc_id", *counts, F.sha2(personal_data.listed(base), 256).alias("base_sha256"), personal_data.listed(F.col("spans")).alias("spans"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
