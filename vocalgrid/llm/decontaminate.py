"""Operator 9 [native]: benchmark decontamination by spaced-seed hashing.

Method: fixed masks choose some of the words in a short stretch and ignore the others, so a substituted word
under a gap leaves the seed equal. Seeds of benchmark items and of documents are joined; a hit fixes a diagonal
(document place minus item place). On each hit diagonal the document's words are compared with the item's over the
item's whole length. It is a leak when some stretch, of which at least two thirds of the words are equal, holds at least
``min_words`` equal words, or ``min_share`` of a shorter item. Shown is the stretch with the most points, +1 for an equal
word and -2 for a substituted one, where it holds as many itself; otherwise the stretch with the most equal words.

Seeds: one of the three masks fits between the substitutions wherever these stand, for items of 6 to 16 words at the
default limits and for 13 equal words of up to 19, 14 of 20 and 21 (enumerated in the tests up to 19). Items of 1, 2, 3 and 5
words have masks of their own, which are used only if the benchmark holds such items.

Defined cases: null or empty texts have no seeds and no leaks; items with equal
texts share one search and all are reported; repeated documents are reported once; a null ``doc_id`` is
carried as it is; other columns are ignored or carried, whatever their names; empty tables give an empty result.
Sides: the item seeds are broadcast only if counted at most ``BROADCAST_SEEDS``, the keys of documents with a hit if at most
``BROADCAST_KEYS``; otherwise Spark joins by shuffle and may split hot keys. Hits are summed per diagonal before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocalgrid.llm.common import own_columns, row_key, small_side, spare_names
from vocalgrid.llm.words import let, windows, word_hashes
from vocalgrid.session import pinned

# Offsets of the words each mask keeps: 1111, 11101 and 11011.
MASKS = ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4))
# For items of just so many words, where the masks above do not fit or miss one substitution.
SHORT_MASKS = {1: (0,), 2: (0, 1), 3: (0, 1, 2), 5: (0, 2, 3, 4)}
MIN_WORDS = 13
MIN_SHARE = 0.8
BROADCAST_SEEDS = 1_000_000


def _seeds(rows: DataFrame, key: str, short: list[int], item: bool = False) -> DataFrame:
    """(key, place, seed) of all masks, those of the ``short`` lengths included; an item has the latter at its own length only."""
    h = F.col("h")
    kinds = [windows(h, mask, k + 1) for k, mask in enumerate(MASKS)]
    for n in short:
        made = windows(h, SHORT_MASKS[n], len(MASKS) + n)
        kinds.append(F.when(F.size(h) == n, made).otherwise(F.array().cast("array<long>")) if item else made)
    held = rows.select(key, word_hashes(F.col("text")).alias("h")).where(F.size("h") > 0).select(key, *[s.alias(f"s{k}") for k, s in enumerate(kinds)])
    held = held.select(key, *[F.size(f"s{k}").alias(f"n{k}") for k in range(len(kinds))], F.concat(*[f"s{k}" for k in range(len(kinds))]).alias("seeds"))
    placed = held.select(key, *[f"n{k}" for k in range(len(kinds))], F.posexplode("seeds").alias("place", "seed"))
    place, before = F.col("place"), F.lit(0)
    for k in range(len(kinds) - 1):
        before = before + F.col(f"n{k}")
        place = F.when(F.col("place") >= before, F.col("place") - before).otherwise(place)
    return placed.select(key, place.alias("place"), "seed")


def best_stretch(equal: Column) -> Column:
    """Of an array of booleans, the stretch with the most +1/-2 points: first, end, and equal words in it."""
    state = "struct<at:int,first:int,points:int,same:int,best:int,bfirst:int,bend:int,bsame:int>"
    zero = F.struct(*[F.lit(0).alias(n) for n in ("at", "first", "points", "same", "best", "bfirst", "bend", "bsame")]).cast(state)

    def step(s: Column, e: Column) -> Column:
        fresh = s["points"] <= 0
        first = F.when(fresh, s["at"]).otherwise(s["first"])
        points = F.when(fresh, F.lit(0)).otherwise(s["points"]) + F.when(e, 1).otherwise(-2)
        same = F.when(fresh, F.lit(0)).otherwise(s["same"]) + F.when(e, 1).otherwise(0)
        return let(F.struct(first.alias("f"), points.alias("p"), same.alias("s")), lambda n: F.struct(
            (s["at"] + 1).alias("at"), n["f"].alias("first"), n["p"].alias("points"), n["s"].alias("same"),
            F.greatest(s["best"], n["p"]).alias("best"),
            F.when(n["p"] > s["best"], n["f"]).otherwise(s["bfirst"]).alias("bfirst"),
            F.when(n["p"] > s["best"], s["at"] + 1).otherwise(s["bend"]).alias("bend"),
            F.when(n["p"] > s["best"], n["s"]).otherwise(s["bsame"]).alias("bsame"),
        ).cast(state))

    return F.aggregate(equal, zero, step)


def widest_stretch(equal: Column) -> Column:
    """Of an array of booleans, the stretch with the most equal words among those with +1/-2 points of 0 or more: first, end, equal words.

    ``low[d]`` is the first place where the points from the start are -d or less, with the equal words before it: the
    longest stretch up to a place with -d points starts there.
    """
    state = "struct<at:int,points:int,same:int,low:array<struct<at:int,same:int>>,bfirst:int,bend:int,bsame:int>"
    nought = F.lit(0)
    zero = F.struct(*[nought.alias(n) for n in ("at", "points", "same")], F.array(F.struct(nought.alias("at"), nought.alias("same"))).alias("low"), *[nought.alias(n) for n in ("bfirst", "bend", "bsame")]).cast(state)

    def step(s: Column, e: Column) -> Column:
        at, points, same = s["at"] + 1, s["points"] + F.when(e, 1).otherwise(-2), s["same"] + F.when(e, 1).otherwise(0)
        deeper = F.greatest(F.lit(1) - points - F.size(s["low"]), F.lit(0))
        here = F.struct(at.alias("at"), same.alias("same"))
        low = F.when(deeper > 0, F.concat(s["low"], F.array_repeat(here, deeper))).otherwise(s["low"])
        start = F.get(s["low"], F.greatest(-points, F.lit(0)))
        more = e & (same - start["same"] > s["bsame"])
        return F.struct(
            at.alias("at"), points.alias("points"), same.alias("same"), low.alias("low"), F.when(more, start["at"]).otherwise(s["bfirst"]).alias("bfirst"),
            F.when(more, at).otherwise(s["bend"]).alias("bend"), F.when(more, same - start["same"]).otherwise(s["bsame"]).alias("bsame"),
        ).cast(state)

    def trimmed(s: Column) -> Column:
        lead = F.array_position(F.slice(equal, s["bfirst"] + 1, s["bend"] - s["bfirst"]), F.lit(True)) - 1
        return F.struct((s["bfirst"] + F.greatest(lead, F.lit(0))).cast("int").alias("bfirst"), s["bend"].alias("bend"), s["bsame"].alias("bsame"))

    return let(F.aggregate(equal, zero, step), trimmed)


def leaks(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE) -> DataFrame:
    """One row per document, item and diagonal: place of the overlap in both, its length and equal words."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row_key", row_key("doc_id", "text"))
    items = benchmark.select("item_id", "text", F.xxhash64("text").alias("item_key")).where("text is not null")
    texts = items.groupBy("item_key").agg(F.first("text").alias("text"))
    sizes = texts.select(F.size(word_hashes(F.col("text"))).alias("n")).where(F.col("n").isin(*SHORT_MASKS)).distinct().collect()
    short = sorted(r["n"] for r in sizes)
    item_seeds = pinned(_seeds(texts, "item_key", short, item=True).select("item_key", F.col("place").alias("item_place"), F.col("seed").alias("item_seed")).distinct())
    if item_seeds.count() <= BROADCAST_SEEDS:
        item_seeds = F.broadcast(item_seeds)
    found = _seeds(rows, "row_key", short).join(item_seeds, F.col("seed") == F.col("item_seed"))
    hits = found.select("row_key", "item_key", (F.col("place") - F.col("item_place")).alias("diagonal")).groupBy("row_key", "item_key", "diagonal").agg(F.count(F.lit(1)).alias("hits"))
    hits = pinned(hits)
    # Whole texts stay where they are while the keys of those with a hit are few enough to be sent to them.
    hit_keys = small_side(pinned(hits.select("row_key").distinct()))
    hit_rows = rows.join(hit_keys, "row_key", "left_semi").dropDuplicates(["row_key"])
    own = hit_rows.select("row_key", "doc_id", word_hashes(F.col("text")).alias("doc_words"))
    item_words = texts.select("item_key", word_hashes(F.col("text")).alias("item_words"))
    start = F.greatest(F.col("diagonal"), F.lit(0))
    skipped = F.greatest(-F.col("diagonal"), F.lit(0))
    length = F.least(F.size("doc_words") - start, F.size("item_words") - skipped)
    aligned = hits.join(own, "row_key").join(item_words, "item_key").select(
        "row_key", "doc_id", "item_key", F.size("item_words").alias("item_length"), start.alias("start"), skipped.alias("skipped"),
        F.zip_with(F.slice("doc_words", start + 1, length), F.slice("item_words", skipped + 1, length), lambda a, b: a == b).alias("equal"),
    )
    need = F.least(F.lit(float(min_words)), F.lit(min_share) * F.col("item_length"))
    near = aligned.where(F.size(F.filter("equal", lambda e: e)) >= need)
    judged = near.select("*", best_stretch(F.col("equal")).alias("p"), widest_stretch(F.col("equal")).alias("w")).where(F.col("w.bsame") >= need)
    shown = F.when(F.col("p.bsame") >= need, F.struct("p.bfirst", "p.bend", "p.bsame")).otherwise(F.col("w"))
    judged = judged.select("row_key", "doc_id", "item_key", "start", "skipped", shown.alias("b"))
    return judged.join(items.select("item_key", "item_id"), "item_key").select(
        "row_key", "doc_id", F.col("item_id").cast("long").alias("item_id"), (F.col("start") + F.col("b.bfirst")).cast("long").alias("doc_word"),
        (F.col("skipped") + F.col("b.bfirst")).cast("long").alias("item_word"), (F.col("b.bend") - F.col("b.bfirst")).cast("long").alias("n_words"),
        F.col("b.bsame").cast("long").alias("n_equal"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE) -> DataFrame:
    """``docs`` without the documents that hold a leak; columns unchanged."""
    (key,) = spare_names(docs, "_key")
    bad = small_side(pinned(leaks(docs, benchmark, min_words, min_share).select(F.col("row_key").alias(key)).distinct()))
    keyed = docs.withColumn(key, row_key(F.col("doc_id").cast("long"), "text"))
    return keyed.join(bad, key, "left_anti").select(*own_columns(docs))
