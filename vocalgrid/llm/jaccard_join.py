"""Operator 2: near-duplicate documents by an n-gram Jaccard join with MinHash banding.

Method:
1. Words are white-space runs of the lowered text; a document's set holds its 5-word shingles (a shorter text is one
   shingle). Documents with equal sets are one text: a class of copies, joined later by a 64-bit key of the set.
2. Each text gets ``BANDS`` bands of ``ROWS`` minima. A pair of similarity s meets in a band with 1 - (1 - s^ROWS)^BANDS;
   the counts are chosen so that pairs at the threshold meet with ``TARGET`` or more (``banding``). Texts are
   shuffled on band hashes, and texts that share any band, directly or through others, form a candidate group.
3. In a candidate group pairs are verified on the full shingle sets. A group is cut into blocks of ``BLOCK`` texts by hash;
   a unit of work holds two blocks, so its memory is bounded whatever the group. Units send on how many
   verified links each text has and a spanning forest of them: rows in proportion to texts, never pairs.
4. Connected texts form a class, named by its smallest ``doc_id``.

Result per document: ``class_id``, ``n_links`` (other different texts at the threshold or above, each verified),
``n_copies`` (documents with the same set, itself included).

Defined cases: null and empty texts are similar to nothing and are their own class; repeated rows are copies; a
null ``doc_id`` takes part, a class of only such has a null id; other columns are ignored or carried, whatever their names; empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalgrid.llm.common import components, own_columns, row_key, small_side, spare_names
from vocalgrid.llm.textkit import mix, slices, windows_of, words_of
from vocalgrid.session import pinned

SHINGLE = 5
THRESHOLD = 0.8
TARGET = 0.99
ROWS = 8
BLOCK = 256


def banding(threshold: float = THRESHOLD, target: float = TARGET, rows: int = ROWS) -> tuple[int, int]:
    """(bands, rows): the least bands that let a pair at the threshold meet with the target recall."""
    return int(np.ceil(np.log(1 - target) / np.log(1 - threshold**rows))), rows


def _shingles(data: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = words_of(data, ends)
    at, value = windows_of(words, SHINGLE)
    first = np.searchsorted(words.text[at], np.arange(len(ends) + 1)) if len(at) else np.zeros(len(ends) + 1, np.int64)
    for i in range(len(ends)):
        n = words.first[i + 1] - words.first[i]
        if n >= SHINGLE:
            yield np.unique(value[first[i] : first[i + 1]])
        elif n:
            one = np.zeros(1, np.uint64)
            for h in words.hash[words.first[i] : words.first[i + 1]]:
                one = mix(one * np.uint64(31) + h)
            yield one
        else:
            yield np.zeros(0, np.uint64)


def _lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))


def signatures(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """doc_id, row_key, set_key (null for texts without words) and the band hashes of every document."""
    bands, rows = banding(threshold, target)
    draw = np.random.default_rng(11)
    factor = draw.integers(0, 1 << 63, (bands * rows, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    offset = draw.integers(0, 1 << 63, (bands * rows, 1), dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, ends in slices(_lowered(batch.column(2))):
                keys, made = [], []
                for s in _shingles(data, ends):
                    if not len(s):
                        keys.append(None)
                        made.append([])
                        continue
                    keys.append(int(mix(np.array([mix(s).sum(dtype=np.uint64) ^ np.uint64(len(s))], np.uint64)).view(np.int64)[0]))
                    low = np.full((bands * rows, 1), np.iinfo(np.uint64).max, np.uint64)
                    for k in range(0, len(s), 2048):
                        part = (s[None, k : k + 2048] * factor + offset) >> np.uint64(16)
                        low = np.minimum(low, part.min(axis=1, keepdims=True))
                    grid = low.reshape(bands, rows)
                    value = np.arange(1, bands + 1, dtype=np.uint64)
                    for c in range(rows):
                        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + grid[:, c])
                    made.append(value.view(np.int64))
                lengths = np.concatenate([[0], np.cumsum([len(m) for m in made])]).astype(np.int32)
                flat = np.concatenate([np.asarray(m, np.int64) for m in made]) if made else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat))],
                    names=["doc_id", "row_key", "set_key", "bands"],
                )

    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key("doc_id", "text").alias("row_key"), "text")
    return rows_in.mapInArrow(run, "doc_id long, row_key long, set_key long, bands array<long>")


def candidate_groups(texts: DataFrame) -> DataFrame:
    """(node, group): texts that share a band, directly or through others. ``texts`` has node and bands.

    Every text of a bucket is tied to the bucket's smallest text: as many edges as texts, none between all.
    """
    held = texts.select("node", F.explode("bands").alias("bucket"))
    smallest = held.groupBy("bucket").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    edges = held.join(smallest, "bucket").where("node <> low").select(F.col("node").alias("u"), F.col("low").alias("v")).distinct()
    return components(edges).select("node", F.col("root").alias("group"))


def _verified(threshold: float):
    def run(unit: pd.DataFrame) -> pd.DataFrame:
        """All pairs of a unit: within one block, or between its two blocks."""
        unit = unit.sort_values(["node"], kind="stable")
        node, side = unit["node"].to_numpy(), unit["side"].to_numpy()
        sets = [np.asarray(s, np.int64) for s in unit["shingles"]]
        sizes = np.array([len(s) for s in sets])
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        kinds, column = np.unique(flat, return_inverse=True)
        order = np.argsort(column, kind="stable")
        rows_of, starts = owner[order], np.concatenate([[0], np.cumsum(np.bincount(column, minlength=len(kinds)))])
        two = bool(unit["low"].iloc[0] != unit["high"].iloc[0])  # a block of the two may be empty
        left = np.flatnonzero(side == 0) if two else np.arange(len(sets))
        links = np.zeros(len(sets), np.int64)
        parent = np.arange(len(sets))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        offsets = np.concatenate([[0], np.cumsum(sizes)])
        for i in left:
            own = column[offsets[i] : offsets[i + 1]]
            lengths = starts[own + 1] - starts[own]
            at = np.repeat(starts[own] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            shared = np.bincount(rows_of[at], minlength=len(sets))
            near = shared >= threshold * (sizes + sizes[i] - shared) - 1e-9
            near &= (side == 1) if two else (np.arange(len(sets)) > i)
            found = np.flatnonzero(near)
            links[i] += len(found)
            links[found] += 1
            for j in found:
                a, b = find(int(i)), find(int(j))
                if a != b:
                    parent[max(a, b)] = min(a, b)
        root = np.array([find(k) for k in range(len(sets))])
        out = pd.DataFrame({"node": node, "root": node[root], "links": links})
        return out[out["links"] > 0]

    return run


def links(texts: DataFrame, groups: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, root, links) per text and unit with a verified link; ``texts`` has node and shingles of grouped texts."""
    size = groups.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    blocks = groups.join(size, "group").select("node", "group", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    own = blocks.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    units = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.select(
        "node", "group", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"),
    )
    work = units.join(texts, "node")
    return work.groupBy("group", "low", "high").applyInPandas(_verified(threshold), "node long, root long, links long")


def _with_shingles(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, ends in slices(_lowered(batch.column(1))):
                sets = list(_shingles(data, ends))
                lengths = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat))], names=["node", "shingles"]
                )

    return docs.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, n_copies."""
    return _classes(docs, threshold, target).drop("row_key", "set_key", "member")


def _classes(docs: DataFrame, threshold: float, target: float) -> DataFrame:
    signed = pinned(signatures(docs, threshold, target))
    copies = pinned(signed.where("set_key is not null").groupBy(F.col("set_key").alias("node")).agg(
        F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_copies"), F.min_by("row_key", "doc_id").alias("by_id"), F.min("row_key").alias("any"),
        F.first("bands").alias("bands"),
    ))
    groups = candidate_groups(copies.select("node", "bands"))
    # One text stands for all copies; only texts in a group are read again.
    standing = groups.join(copies.select("node", F.coalesce("by_id", "any").alias("_key")), "node").select("node", "_key")
    keyed = docs.select(row_key(F.col("doc_id"), "text").alias("_key"), "text")
    texts = keyed.join(small_side(pinned(standing)), "_key").dropDuplicates(["node"])
    found = pinned(links(_with_shingles(texts), groups, threshold))
    classes = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    counted = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    named = copies.drop("bands", "by_id", "any").join(counted, "node", "left").join(classes, "node", "left").select(
        "node", "least", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "node").alias("root")
    )
    smallest = named.groupBy("root").agg(F.min("least").alias("class_id"), F.min_by("node", F.struct(F.col("least").isNull(), "least", "node")).alias("member"))
    result = named.join(smallest, "root").select("node", "class_id", "n_links", "n_copies", "member")
    return signed.drop("bands").join(result.withColumnRenamed("node", "set_key"), "set_key", "left").select(
        "doc_id", F.when(F.col("member").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), "row_key", "set_key", "member",
    )


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """One document of each class, that with the smallest ``doc_id``; texts without words all stay.

    Among repeated rows of that document one stays, chosen without gathering: the copies' counter breaks the tie.
    """
    judged = _classes(docs, threshold, target)
    key, text = spare_names(docs, "_key", "_text")
    standing = judged.where((F.col("member").isNull()) | ((F.col("set_key") == F.col("member")) & (F.col("doc_id").eqNullSafe(F.col("class_id")))))
    keys = standing.groupBy("row_key").agg(F.first("set_key").alias("set_key")).select(F.col("row_key").alias(key), F.col("set_key").alias(text))
    kept = docs.withColumn(key, row_key("doc_id", "text")).join(keys, key)
    single = kept.where(F.col(text).isNotNull()).dropDuplicates([text])
    return kept.where(F.col(text).isNull()).select(*own_columns(docs)).union(single.select(*own_columns(docs)))
