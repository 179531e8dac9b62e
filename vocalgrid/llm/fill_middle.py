"""Operator 12: fill-in-the-middle transformation by repeated-capture matching.

Method: a text is a repetition of units, by default lines with their line end. One full match of ``(unit)*`` by the regex
library retains every repetition of its group; ``match.ends(1)`` is then the list of all unit ends, so its length is the number
of units and two look-ups in it are both cut offsets. No loop runs over units.

The cuts, whether a document is transformed, and which form it takes come from four numbers: the first four groups of eight
digits of sha256 of ``seed:doc_id``. They depend on nothing else, so a repeated task gives the same rows.

Forms: ``psm`` is ``<P>`` prefix ``<S>`` suffix ``<M>`` middle; ``spm`` is ``<S>`` suffix ``<P>`` prefix ``<M>`` middle; ``plain`` is the
text itself, for empty texts, texts that hold a sentinel, and the share left out by ``rate``.

Defined cases: a null text is the empty text, with no units; a null ``doc_id`` draws as an empty name; repeated rows give
repeated results; a text without a line end is one unit; extra columns are not looked at, whatever their names; an empty table
gives an empty result. A text of any length is matched whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = r"[^\n]*\n|[^\n]+"
SEED, RATE, SPM = 7, 100, 50
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
STEP_BYTES = 1 << 24


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))


def repetitions(unit: str) -> regex.Pattern:
    """Pattern whose full match retains every unit as a capture of group 1. Units are taken whole: nothing is tried twice."""
    return regex.compile(f"((?>{unit}))*+")


def transformed(text: str | None, numbers: tuple[int, int, int, int], pattern: regex.Pattern, rate: int = RATE, spm: int = SPM) -> tuple:
    """(units, form, prefix characters, middle characters, output) of one text."""
    text = text or ""
    match = pattern.fullmatch(text)
    if match is None:
        raise ValueError("the units do not make up the whole text")
    ends = match.ends(1)
    n = len(ends)
    h1, h2, h3, h4 = numbers
    if not text or h3 % 100 >= rate or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    first, second = (ends[k - 1] if k else 0 for k in (low, high))
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if h4 % 100 < spm:
        return n, "spm", first, second - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", first, second - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, unit: str = UNIT, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """doc_id, units, form, characters of prefix and middle (null if plain) and the output text of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = repetitions(unit)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            made, held, begin = [], 0, 0
            for k in range(len(batch)):
                row = transformed(texts[k].as_py(), draws(seed, ids[k].as_py()), pattern, rate, spm)
                made.append(row)
                held += len(row[4])
                # Results leave in parts of bounded size, whatever the batch.
                if held >= STEP_BYTES or k + 1 == len(batch):
                    columns = [pa.array(c, t) for c, t in zip(zip(*made), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]
                    yield pa.RecordBatch.from_arrays([ids.slice(begin, k + 1 - begin), *columns], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
                    made, held, begin = [], 0, k + 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The exact text, rebuilt from output and form: sentinels stand nowhere else in a transformed text."""
    after = lambda text, mark: F.substring_index(text, mark, -1)
    before = lambda text, mark: F.substring_index(text, mark, 1)
    middle = after(output, MIDDLE)
    psm = F.concat(after(before(output, SUFFIX), PREFIX), middle, after(before(output, MIDDLE), SUFFIX))
    spm = F.concat(after(before(output, MIDDLE), PREFIX), middle, after(before(output, PREFIX), SUFFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
