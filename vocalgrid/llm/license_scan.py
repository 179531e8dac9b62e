"""Operator 5 [native]: license scans by diagonal voting.

Method: all rolling word 3-gram hashes of the texts are joined with the template positions; votes are counted per
document, template and offset diagonal (place in the text minus place in the template); neighbouring diagonals
(words added or left out) merge into one span; a span is verified by the share of the template's words that its
voting 3-grams cover and by its length. The base phrases are counted on the texts themselves.

Defined cases: null text is empty (no words, labels empty strings, score 0, places null); repeated rows give
repeated results; a null ``doc_id`` is carried; other columns are ignored; empty tables stay empty.
The templates are a fixed list, so their broadcast is bounded by the code.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vocalgrid.llm.common import row_key
from vocalgrid.llm.words import let, windows, word_hashes, words

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Well-known license notices, by the label they stand for.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2.0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2.0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4.0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2.0"),
)
GRAM = 3
NEAR = 2
MIN_COVER = 0.8
MAX_STRETCH = 1.5


def templates(spark: SparkSession) -> DataFrame:
    rows = [(i, label, text) for i, (label, text) in enumerate(TEMPLATES)]
    return spark.createDataFrame(rows, "template int, label string, text string")


def _grams(rows: DataFrame, *keys: str) -> DataFrame:
    held = rows.select(*keys, word_hashes(F.col("text")).alias("h")).where(F.size("h") >= GRAM)
    return held.select(*keys, F.posexplode(windows(F.col("h"), tuple(range(GRAM)))).alias("place", "gram"))


def spans(docs: DataFrame, min_cover: float = MIN_COVER) -> DataFrame:
    """Verified spans: row_key, label, first word, end word, share of the template covered. ``docs`` has row_key and text."""
    spark = docs.sparkSession
    known = templates(spark)
    places = _grams(known, "template", "label").select("template", F.col("place").alias("t"), F.col("gram").alias("tgram"))
    lengths = known.select("template", "label", F.size(word_hashes(F.col("text"))).alias("length"))
    hits = _grams(docs, "row_key").join(F.broadcast(places), F.col("gram") == F.col("tgram")).select("row_key", "template", "place", "t")
    votes = hits.withColumn("diagonal", F.col("place") - F.col("t")).groupBy("row_key", "template", "diagonal").agg(
        F.min("place").alias("first"), F.max("place").alias("last"), F.collect_set("t").alias("ts")  # no more than the template's places
    )
    # Diagonals of one document and template, in order; a jump of more than NEAR starts a new span.
    order = Window.partitionBy("row_key", "template").orderBy("diagonal")
    jump = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order), F.lit(NEAR + 1)) > NEAR
    merged = votes.withColumn("jump", jump.cast("int")).withColumn("run", F.sum("jump").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # Runs are joined from a bounded number of diagonals by length, so the set stays within the template.
    per_run = merged.select("*", F.explode("ts").alias("place_in_template")).groupBy("row_key", "template", "run").agg(
        F.min("first").alias("first"), (F.max("last") + GRAM).alias("end"), F.collect_set("place_in_template").alias("ts")
    )
    covered = F.array_distinct(F.flatten(F.transform("ts", lambda t: F.sequence(t, t + F.lit(GRAM - 1)))))
    judged = per_run.join(F.broadcast(lengths), "template").withColumn("cover", F.size(covered) / F.col("length"))
    return judged.where((F.col("cover") >= min_cover) & (F.col("end") - F.col("first") <= MAX_STRETCH * F.col("length"))).select(
        "row_key", "label", "first", "end", "cover"
    )


def base_columns(text: Column) -> Column:
    """Struct of ``n_words`` and, per base phrase, the places where its words stand consecutively."""

    def of(w: Column) -> Column:
        def places(phrase: str) -> Column:
            parts = phrase.split()
            at = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: functools.reduce(
                lambda a, b: a & b, [F.coalesce(F.get(w, i + F.lit(k)) == part, F.lit(False)) for k, part in enumerate(parts)]))
            return at

        def found(joined: Column) -> Column:
            # Words hold no space, so the joined text holds a phrase just where its words stand consecutively.
            none = F.array().cast("array<int>")
            return F.struct(F.size(w).cast("long").alias("n_words"), *[
                F.when(F.contains(joined, F.lit(f" {p} ")), places(p)).otherwise(none).alias(f"p{k}") for k, p in enumerate(BASE)])

        return let(F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" ")), found)

    return let(words(text), of)


def license_report(docs: DataFrame, min_cover: float = MIN_COVER) -> DataFrame:
    """One row per document: base counts and places, base labels, all labels and a score."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row_key", row_key("doc_id", "text"))
    base = rows.select("row_key", "doc_id", base_columns(F.col("text")).alias("b")).select(
        "row_key", "doc_id", "b.n_words", F.concat(*[f"b.p{k}" for k in range(len(BASE))]).alias("places"),
        F.array_compact(F.array(*[F.when(F.size(f"b.p{k}") > 0, F.lit(label)) for k, label in enumerate(BASE.values())])).alias("base_list"),
    ).select("*", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"))
    per_doc = spans(rows.select("row_key", "text"), min_cover).groupBy("row_key").agg(
        F.collect_set("label").alias("method_list"), F.max("cover").alias("cover"), F.count(F.lit(1)).alias("n_spans")
    )
    # Copies of a row vote together; every label and share is the same, so their spans count once for each.
    joined = base.join(per_doc, "row_key", "left")
    nothing = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union("base_list", F.coalesce("method_list", nothing)))
    score = F.greatest(F.least(F.coalesce("cover", F.lit(0.0)), F.lit(1.0)), F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base_list"), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"), score.alias("score"),
    )
