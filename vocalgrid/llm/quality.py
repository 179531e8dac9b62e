"""Operator 6: quality rules with cross-document line frequency.

Method: every line with a word is normalised (ASCII letters lowered, white space runs to one space, trimmed)
and hashed. A line's frequency is its number of distinct documents within one host (``source``). Lines found
in more than ``max_documents`` documents of their host are removed; a document of which more than
``max_removed`` of its words stand in removed lines is depleted and rejected.

Copies of one document are one document here: a document is known by the hash of its whole set of line hashes, so thousands of
copies of equal lines do not turn their own lines into boilerplate. Any other document counts, however many lines it shares: a menu
under thousands of different articles counts each of them, and near copies that differ in a line are different documents.

Base rules (contract): too few words, or too many words in repeated 3-word windows.

Defined cases: null text has no words, fails the base rules and is rejected; a null host is a host of its own;
repeated rows give repeated results; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalgrid.llm.common import own_columns, row_key, spare_names
from vocalgrid.llm.textkit import ASCII_SPACE, BASE, mix, per_text, powers, slices, windows_of, words_of
from vocalgrid.session import pinned

MAX_DOCUMENTS = 20
MAX_REMOVED = 0.8
MIN_WORDS = 50

_NEWLINE = 0x0A
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

PARSED = (
    "row_key long, doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "line_hashes array<long>, line_words array<long>"
)


def _line_table(data: np.ndarray, ends: np.ndarray, words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per line with a word: text, exact hash, normalised hash, words."""
    breaks = np.zeros(len(data) + 1, dtype=np.int64)
    breaks[1:][data == _NEWLINE] += 1
    breaks[ends] += 1  # a text's end also ends its last line
    line_of_byte = np.cumsum(breaks)
    line = line_of_byte[words.start]
    starts = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, dtype=np.int64)
    counts = np.diff(np.append(starts, len(line)))
    lowered = words_of(_LOWER[data], ends).hash
    normal = np.zeros(len(starts), dtype=np.uint64)
    if len(starts):
        # Polynomial over the words of the line; places count from the line's first word.
        place = np.arange(len(line)) - np.repeat(starts, counts)
        top = int(place.max()) + 1
        normal = mix(np.add.reduceat(lowered * powers(BASE, top)[place], starts))
    return words.text[starts], starts, normal, counts


def _exact_line_duplicates(data: np.ndarray, ends: np.ndarray, texts: int) -> np.ndarray:
    """Lines with a word equal, byte for byte, to an earlier line of their text."""
    separators = np.zeros(256, dtype=bool)
    separators[_NEWLINE] = True
    lines = words_of(data, ends, separators)
    if not len(lines.start):
        return np.zeros(texts, dtype=np.int64)
    wordy = np.add.reduceat(~ASCII_SPACE[data], lines.start) > 0 if len(lines.start) else np.zeros(0, dtype=bool)
    text, value = lines.text[wordy], lines.hash[wordy]
    order = np.lexsort((value, text))
    again = (text[order][1:] == text[order][:-1]) & (value[order][1:] == value[order][:-1])
    return np.bincount(text[order][1:][again], minlength=texts)


def _repeated_window_words(words, texts: int) -> np.ndarray:
    """Words inside 3-word windows that the text holds twice or more."""
    at, value = windows_of(words, 3)
    covered = np.zeros(len(words.hash) + 3, dtype=np.int64)
    if len(at):
        key = mix(value ^ mix(words.text[at].astype(np.uint64) + np.uint64(1)))
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        hit = at[counts[inverse] > 1]
        for k in range(3):
            covered[hit + k] = 1
    return per_text(covered[: len(words.hash)], words.text, texts)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, ends in slices(batch.column("text")):
            texts = j - i
            words = words_of(data, ends)
            code_point = (data & 0xC0) != 0x80
            text_of_byte = np.repeat(np.arange(texts), np.diff(np.concatenate([[0], ends])))
            line_text, _, normal, line_words = _line_table(data, ends, words)
            # Distinct lines of each text with their words summed.
            order = np.lexsort((normal, line_text))
            t, h, w = line_text[order], normal[order], line_words[order]
            new = np.concatenate([[True], (t[1:] != t[:-1]) | (h[1:] != h[:-1])]) if len(t) else np.zeros(0, dtype=bool)
            firsts = np.flatnonzero(new)
            summed = np.add.reduceat(w, firsts) if len(firsts) else w
            t, h = t[firsts], h[firsts]
            offsets = np.searchsorted(t, np.arange(texts + 1)).astype(np.int32)
            # Sorted inside a text, so its first line hash is its smallest.
            hashes = pa.ListArray.from_arrays(pa.array(offsets), pa.array(h.view(np.int64)))
            counts = pa.ListArray.from_arrays(pa.array(offsets), pa.array(summed.astype(np.int64)))
            part = batch.slice(i, texts)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("row_key"), part.column("doc_id"), part.column("host"), pa.array(words.counts.astype(np.int64)),
                    pa.array(per_text(code_point & ~ASCII_SPACE[data], text_of_byte, texts)),
                    pa.array(per_text(_SYMBOL[data], text_of_byte, texts)),
                    pa.array(_exact_line_duplicates(data, ends, texts).astype(np.int64)),
                    pa.array(_repeated_window_words(words, texts)), hashes, counts,
                ],
                names=["row_key", "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_hashes", "line_words"],
            )


def parsed(docs: DataFrame, host: str = "source") -> DataFrame:
    """Counts of each document and its distinct line hashes; the texts are read once, whole."""
    rows = docs.select(
        row_key("doc_id", host, "text").alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), "text"
    )
    return rows.mapInArrow(_parse, PARSED)


def frequent_lines(rows: DataFrame, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """(host, line) found in more than ``max_documents`` different documents of the host."""
    # The hashes of a document are distinct and sorted, so equal sets have equal keys.
    lines = rows.select("host", F.xxhash64("line_hashes").alias("document"), F.explode("line_hashes").alias("line"))
    # Distinct first: the key holds the document's identity, so a line under a third of all documents is spread.
    return lines.distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("documents")).where(F.col("documents") > max_documents)


def removed_lines(rows: DataFrame, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """Per document with removed lines: their hashes and the words they take away."""
    lines = rows.dropDuplicates(["row_key"]).select("row_key", "host", F.explode(F.arrays_zip("line_hashes", "line_words")).alias("l")).select(
        "row_key", "host", F.col("l.line_hashes").alias("line"), F.col("l.line_words").alias("words")
    )
    frequent = frequent_lines(rows, max_documents).select(F.col("host").alias("_host"), F.col("line").alias("_line"))
    hit = lines.join(frequent, F.col("host").eqNullSafe(F.col("_host")) & (F.col("line") == F.col("_line")))
    # A document's own lines bound the list.
    return hit.groupBy("row_key").agg(F.sum("words").alias("removed_words"), F.collect_list("line").alias("removed"))


def judged(rows: DataFrame, max_documents: int = MAX_DOCUMENTS, max_removed: float = MAX_REMOVED) -> DataFrame:
    """Base counts, removed words and the verdict, for ``parsed`` rows that are kept (checkpointed)."""
    gone = removed_lines(rows, max_documents)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    joined = rows.drop("line_hashes", "line_words").join(gone, "row_key", "left")
    lost = F.coalesce("removed_words", F.lit(0))
    return joined.select(
        "row_key", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (lost <= max_removed * F.col("n_words"))).alias("kept"), lost.alias("removed_words"), "removed",
    )


def quality_report(docs: DataFrame, host: str = "source", max_documents: int = MAX_DOCUMENTS, max_removed: float = MAX_REMOVED) -> DataFrame:
    """One row per document: counts, ``base_failed``, ``kept``, ``removed_words``."""
    return judged(pinned(parsed(docs, host)), max_documents, max_removed).drop("row_key", "removed")


def _without(texts: pd.Series, removed: pd.Series) -> pd.Series:
    def one(text: str, gone) -> str:
        lines = text.split("\n")
        data = [x.encode() for x in lines]
        flat = np.frombuffer(b"".join(data), dtype=np.uint8)
        ends = np.cumsum([len(x) for x in data])
        line, _, normal, _ = _line_table(flat, ends, words_of(flat, ends))
        drop = set(line[np.isin(normal.view(np.int64), np.asarray(gone, dtype=np.int64))].tolist())
        return "\n".join(x for k, x in enumerate(lines) if k not in drop)

    return pd.Series([t if g is None or t is None else one(t, g) for t, g in zip(texts, removed)], index=texts.index, dtype=object)


def quality_filtered(docs: DataFrame, host: str = "source", max_documents: int = MAX_DOCUMENTS, max_removed: float = MAX_REMOVED) -> DataFrame:
    """Kept documents with their frequent lines removed, in the columns of ``docs``; ``n_chars`` follows the text."""
    verdicts = judged(pinned(parsed(docs, host)), max_documents, max_removed).where("kept").select("row_key", "removed").dropDuplicates(["row_key"])
    strip = F.pandas_udf(_without, "string")
    key, removed = spare_names(docs, "_key", "_removed")
    kept = docs.withColumn(key, row_key("doc_id", host, "text")).join(verdicts.select(F.col("row_key").alias(key), F.col("removed").alias(removed)), key)
    text = F.when(F.col(removed).isNull(), F.col("text")).otherwise(strip("text", removed))
    out = kept.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*own_columns(docs))
