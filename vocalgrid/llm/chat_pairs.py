"""Operator 1 [native]: preference formatting of chosen and rejected conversations.

Method: the longest common prefix of turns (equal role and text) of a pair is rendered once as the prompt; what
follows in either conversation is rendered as its completion. A completion is masked: only the text of
assistant turns and their end mark is trained on, the role headers and all other turns are not. Masks are character
spans within the completion.

Rendering: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn; the two marks inside a text or a role are broken
up by a space, so no text can forge a turn.

Defined cases: a null role or text equals only another null and renders as empty; equal conversations have an empty
completion on both sides; no turn in common gives an empty prompt; a null side counts as an empty conversation;
ties of turn numbers are ordered by role and text; other columns are carried along (one that bears the name of a result column
with ``_in`` behind its name); repeated rows are formatted each; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocalgrid.llm.common import spare_names
from vocalgrid.llm.words import let

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"
TURNS = "array<struct<role:string,text:string>>"


def _clean(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|im_"), F.lit("<| im_"))


def _header(turn: Column) -> Column:
    return F.concat(F.lit(START), _clean(turn["role"]), F.lit("\n"))


def _rendered(turn: Column) -> Column:
    return F.concat(_header(turn), _clean(turn["text"]), F.lit(END + "\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two turn arrays."""
    same = F.zip_with(a, b, lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]) & x.isNotNull() & y.isNotNull())
    return let(F.array_position(same, F.lit(False)), lambda p: F.when(p > 0, p - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int"))


def mask_spans(turns: Column) -> Column:
    """Character spans [start, end) of the rendered turns to train on: assistant texts and their end marks."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(s: Column, turn: Column) -> Column:
        head, whole = F.length(_header(turn)), F.length(_rendered(turn))
        own = F.struct((s["at"] + head).alias("start"), (s["at"] + whole - 1).alias("end"))
        spans = F.when(turn["role"] == TRAINED, F.array_append(s["spans"], own)).otherwise(s["spans"])
        return F.struct((s["at"] + whole).alias("at"), spans.alias("spans"))

    return F.aggregate(turns, zero, step, lambda s: s["spans"])


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Replace the two turn arrays by ``n_prompt_turns``, ``prompt``, ``chosen``/``rejected`` texts and their masks.

    Any other column whose name the result needs is kept under that name with ``_in`` behind it.
    """
    empty = F.array().cast(TURNS)
    made = ("n_prompt_turns", "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask")
    others = [c for c in pairs.columns if c.lower() not in (chosen.lower(), rejected.lower())]
    kept = {c: c for c in others if c.lower() not in made}
    for c in others:
        if c not in kept:
            (kept[c],) = spare_names(pairs, f"{c}_in")
    own = [F.col("`" + c.replace("`", "``") + "`").alias(name) for c, name in kept.items()]
    turns = F.struct(F.coalesce(F.col(chosen), empty).alias("c"), F.coalesce(F.col(rejected), empty).alias("r"))
    # The turns ride in one struct of a name of their own, so no caller's column meets them.
    (inner,) = spare_names(pairs, "_turns")
    sides = pairs.select(*own, turns.alias(inner))
    c, r = F.col(f"{inner}.c"), F.col(f"{inner}.r")
    sides = sides.withColumn(inner, F.struct(c.alias("c"), r.alias("r"), common_turns(c, r).alias("n")))
    c, r, n = (F.col(f"{inner}.{x}") for x in "crn")
    rest = lambda side: F.slice(side, n + 1, F.size(side))
    result = (n, rendered(F.slice(c, 1, n)), rendered(rest(c)), rendered(rest(r)), mask_spans(rest(c)), mask_spans(rest(r)))
    return sides.select(*[F.col("`" + name.replace("`", "``") + "`") for name in kept.values()], *[x.alias(name) for x, name in zip(result, made)])


def stale_answer_pairs(conversations: DataFrame) -> DataFrame:
    """A preference pair from each conversation with an answer: conv_id, chosen and rejected turn arrays.

    Chosen is the conversation up to its last assistant turn. Rejected ends in a stale answer instead: the text of
    the assistant turn before it, or, where there is none, an echo of the turn before it (empty if none).
    A conversation without an assistant turn gives no pair, turns after the last answer are left out, and turns with a null
    ``conv_id`` are one conversation. Turns are gathered per conversation, as one row holds one conversation in the result too.
    """
    turn = F.struct("turn", "role", "text")
    whole = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def last_answer(turns: Column) -> Column:
        return F.size(turns) - F.array_position(F.reverse(F.transform(turns, lambda t: F.coalesce(t["role"], F.lit("")))), F.lit(TRAINED)) + 1

    cut = whole.where(F.exists("turns", lambda t: F.coalesce(t["role"], F.lit("")) == TRAINED)).withColumn("n", last_answer(F.col("turns")).cast("int"))
    cut = cut.select("conv_id", F.slice("turns", 1, F.col("n")).alias("chosen"), F.slice("turns", 1, F.col("n") - 1).alias("before"))
    answers = F.filter("before", lambda t: F.coalesce(t["role"], F.lit("")) == TRAINED)
    echo = F.coalesce(F.element_at(F.when(F.size("before") > 0, F.col("before")), -1)["text"], F.lit(""))
    stale = F.when(F.size(answers) > 0, F.coalesce(F.element_at(F.when(F.size(answers) > 0, answers), -1)["text"], F.lit(""))).otherwise(echo)
    plain = lambda turns: F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    wrong = F.array(F.struct(F.lit(TRAINED).alias("role"), stale.alias("text")))
    return cut.select("conv_id", plain(F.col("chosen")).alias("chosen"), F.concat(plain(F.col("before")), wrong).cast(TURNS).alias("rejected"))
