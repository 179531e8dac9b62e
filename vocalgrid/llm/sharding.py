"""Operator 10 [native]: shards by a Feistel permutation, with cycle walking, of global row numbers.

Rows are numbered 0..n-1 in the order of their keys. A keyed permutation of 0..n-1 sends each number to a
place; shard = place mod shards, slot = place div shards. So shard sizes differ by one row at most (law
``rows``), slots are gapless from 0, a seed gives the same shuffle again, and shard and slot of a row number
(``place_of``) and the row number in a slot (``row_at``) are computed without looking at any data.

The network works on pairs (left, right) of a ``a x b`` grid with a = ceil(sqrt n), b = ceil(n / a), so fewer
than a cells lie outside 0..n-1; an image there is permuted again (cycle walking). The walk is bounded by
``WALKS`` steps: enough for certain up to n = 256, beyond that missed with a chance under 1e-18 per row, and
then the row raises an error instead of getting a wrong place.

Defined cases: an empty table gives an empty result; nulls in key columns sort first; rows equal in all key
columns take consecutive numbers in any order, which leaves the multiset of results unchanged; other columns
are carried through by ``shard_rows`` only where the caller lists them as keys.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocalgrid.session import pinned

ROUNDS = 6
WALKS = 16


def grid(n: int) -> tuple[int, int]:
    a = max(math.isqrt(max(n - 1, 0)) + 1, 1)
    return a, max(-(-n // a), 1)


def _rounds(x: Column, a: int, b: int, seed: int, order: Sequence[int], sign: int) -> Column:
    """The rounds in ``order``; even ones move the left half, odd ones the right, forth (sign 1) or back (-1)."""
    base = seed * ROUNDS

    def moved(p: Column, key: Column) -> Column:
        even = F.pmod(key - F.lit(base), F.lit(2)) == 0
        drawn = F.xxhash64(F.when(even, p["r"]).otherwise(p["l"]), key)
        left = F.when(even, F.pmod(p["l"] + F.lit(sign) * F.pmod(drawn, F.lit(a)), F.lit(a))).otherwise(p["l"])
        right = F.when(even, p["r"]).otherwise(F.pmod(p["r"] + F.lit(sign) * F.pmod(drawn, F.lit(b)), F.lit(b)))
        return F.struct(left.alias("l"), right.alias("r"))

    pair = F.struct(F.floor(x / F.lit(b)).cast("long").alias("l"), F.pmod(x, F.lit(b)).alias("r"))
    keys = F.array(*[F.lit(base + k) for k in order])
    return F.aggregate(keys, pair, moved, lambda p: p["l"] * F.lit(b) + p["r"])


def _forward(x: Column, a: int, b: int, seed: int) -> Column:
    return _rounds(x, a, b, seed, range(ROUNDS), 1)


def _backward(x: Column, a: int, b: int, seed: int) -> Column:
    return _rounds(x, a, b, seed, range(ROUNDS - 1, -1, -1), -1)


def _walked(x: Column, n: int, step) -> Column:
    walked = F.aggregate(F.sequence(F.lit(2), F.lit(WALKS)), step(x), lambda y, _: F.when(y < n, y).otherwise(step(y)))
    checked = F.transform(F.array(walked), lambda y: F.when(y < n, y).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long")))
    return checked[0]


def permuted(x: Column, n: int, seed: int) -> Column:
    """The place of row number ``x`` among 0..n-1."""
    a, b = grid(n)
    return _walked(x.cast("long"), n, lambda y: _forward(y, a, b, seed))


def unpermuted(place: Column, n: int, seed: int) -> Column:
    """The row number at ``place``."""
    a, b = grid(n)
    return _walked(place.cast("long"), n, lambda y: _backward(y, a, b, seed))


def place_of(row_number: Column, n: int, shards: int, seed: int) -> tuple[Column, Column]:
    """Shard and slot of a row number, from numbers alone."""
    place = permuted(row_number, n, seed)
    return F.pmod(place, F.lit(shards)).cast("int"), F.floor(place / F.lit(shards)).cast("long")


def row_at(shard: Column, slot: Column, n: int, shards: int, seed: int) -> Column:
    """Row number in a slot: the inverse of ``place_of``."""
    return unpermuted(slot.cast("long") * F.lit(shards) + shard.cast("long"), n, seed)


def numbered(df: DataFrame, keys: Sequence[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """Global row numbers 0..n-1 in key order, and n.

    Rows are range-partitioned on the keys and a salt that spreads fully equal rows, checkpointed so that parts
    and places hold, and each partition adds the rows of the partitions before it: one row per partition
    (a count that the cluster bounds, not the data) goes through the window and the broadcast.
    """
    salted = df.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
    order = [F.col(k) for k in [*keys, "_tie"]]
    ranged = salted.repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie")
    placed = pinned(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    parts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", "_n", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    total = parts.agg(F.sum("_n").alias("n")).first()["n"] or 0
    rows = placed.withColumn("_part", part).join(F.broadcast(parts.drop("_n")), "_part")
    number = F.col("_before") + F.col("_at") - F.shiftleft(F.col("_part"), 33)
    return rows.select(*df.columns, number.alias(name)), int(total)


def shard_rows(df: DataFrame, keys: Sequence[str], shards: int = 24, seed: int = 7) -> DataFrame:
    """Number ``df`` (which holds the keys and little more) and add ``row_number``, ``shard`` and ``slot``."""
    rows, n = numbered(df, keys)
    place = rows.withColumn("_place", permuted(F.col("row_number"), max(n, 1), seed))
    return place.select(
        *rows.columns, F.pmod("_place", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("_place") / F.lit(shards)).cast("long").alias("slot")
    )


def document_shards(docs: DataFrame, shards: int = 24, seed: int = 7) -> DataFrame:
    """Shards of documents; texts are read once for size and checksum and never shuffled (null text: empty)."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + F.lit(8)).alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    return shard_rows(rows, ["doc_id", "text_crc32", "size"], shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number"
    )
