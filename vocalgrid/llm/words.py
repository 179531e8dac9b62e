"""Column expressions over words, for the operators that use DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# A word is a run of digits, a-z and characters beyond ASCII, after lower-casing A-Z. Separators as in the contract.
SEPARATORS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also inside lambdas of ``body``."""
    return F.transform(F.array(value), body)[0]


def lowered(text: Column) -> Column:
    """Null as empty; A-Z lowered. The two other characters whose lower case holds an ASCII letter become U+FFFD first."""
    filled = F.coalesce(text, F.lit(""))
    return F.lower(F.replace(F.replace(filled, F.lit("K"), F.lit("�")), F.lit("İ"), F.lit("�")))


def words(text: Column) -> Column:
    return F.array_remove(F.split(lowered(text), f"[{SEPARATORS}]+"), "")


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def windows(hashes: Column, offsets: tuple[int, ...], tag: int = 0) -> Column:
    """Hash of the words at ``offsets`` from each place where all of them exist; ``tag`` keeps kinds apart."""
    span = max(offsets) + 1

    def at(h: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(h) - F.lit(span))
        made = F.transform(places, lambda i: F.xxhash64(F.lit(tag), *[F.get(h, i + F.lit(o)) for o in offsets]))
        return F.when(F.size(h) >= span, made).otherwise(F.array().cast("array<long>"))

    return let(hashes, at)
