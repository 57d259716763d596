"""Licence notices by diagonal voting, with DataFrame functions only.

A text (A-Z lower-cased, null as empty) is a list of words. Every run of ``GRAM`` words is
looked up among the same runs of the templates by hash and compared word by word; a hit at
text place p and template place t votes for the diagonal p - t. A diagonal that holds all
runs of a template is an exact place. Neighbouring diagonals, which a word more or less
leads to, are merged, and the merged span's share of template words is its score.

A phrase of the base rule counts at every exact place, overlapping ones too. A template
of the method's own gives its label from a share of ``COVERED`` on, unless another one has
a larger share of the same place; both kinds are verified by words, not hashes. ``score`` is the largest share of any template (1 for a base place).

Null and empty texts have no words and no labels (the empty text), and a score of 0. Rows
are told apart by their place in the scan, so repeated or null doc_ids are scanned one by
one; a text's hits are few rows, so a source or phrase that a third of all texts hold is
spread like the texts. Only doc_id and text are read; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from latelane.llm.common import written

GRAM = 3
NEIGHBOURS = 2  # diagonals apart that still belong to one span
COVERED = 0.8

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The phrases of the base rule and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Customary words of public licences, for the method's own labels.
NOTICES = [
    ("gpl-2", "under the terms of the gnu general public license as published by the free "
              "software foundation either version 2 of the license or at your option any later "
              "version"),
    ("gpl-2", "gnu general public license version 2"),
    ("gpl-3", "under the terms of the gnu general public license as published by the free "
              "software foundation either version 3 of the license or at your option any later "
              "version"),
    ("gpl-3", "gnu general public license version 3"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl-3", "gnu affero general public license version 3"),
    ("mpl-2", "mozilla public license version 2 0"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this "
            "software and associated documentation files the software to deal in the software "
            "without restriction"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are "
            "permitted provided that the following conditions are met"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain "
                 "a copy of the license at"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc-by-sa", "licensed under cc by sa"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by", "creative commons attribution 4 0 international"),
    ("proprietary", "all rights reserved"),
]


def templates() -> list[tuple[int, str, bool, list[str]]]:
    """(number, label, whether of the base rule, words)."""
    base = [(label, True, phrase.split()) for phrase, label in BASE.items()]
    own = [(label, False, words.split()) for label, words in NOTICES]
    return [(i, *t) for i, t in enumerate(base + own)]


def template_grams(spark: SparkSession) -> DataFrame:
    """(template, label, base, size, place, gram, hash) of every run of the templates."""
    rows = [
        (i, label, base, len(words), at, words[at : at + GRAM])
        for i, label, base, words in templates()
        for at in range(len(words) - GRAM + 1)
    ]
    schema = "template int, label string, base boolean, size int, place int, gram array<string>"
    words = [F.xxhash64(F.col("gram")[k]) for k in range(GRAM)]
    return spark.createDataFrame(rows, schema).withColumn("hash", F.xxhash64(*words))


def words_of(text: str) -> Column:
    """The lower-cased words of a text."""
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lower, _SEPARATORS), "")


def hits(docs: DataFrame, known: list[int]) -> DataFrame:
    """doc_id, row, n_words and ``found``: place, hash and words of each run whose hash is
    one of a template's (``known``: under a few hundred)."""
    gram = "xxhash64(hashes[i], hashes[i + 1], hashes[i + 2])"
    listed = ", ".join(f"{h}L" if h != -(2**63) else "cast('-9223372036854775808' as bigint)" for h in known)
    worded = docs.select(
        "doc_id", F.monotonically_increasing_id().alias("row"), words_of("text").alias("words")
    )
    hashed = worded.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    places = F.expr(
        f"case when size(hashes) < {GRAM} then array() else "
        f"filter(sequence(0, size(hashes) - {GRAM}), i -> {gram} in ({listed})) end"
    )
    found = F.expr(
        f"transform(places, i -> struct(i as at, {gram} as hash, slice(words, i + 1, {GRAM}) as gram))"
    )
    placed = hashed.withColumn("places", places)
    return placed.select("doc_id", "row", F.size("hashes").cast("bigint").alias("n_words"), found.alias("found"))


def diagonals(found: DataFrame, grams: DataFrame) -> DataFrame:
    """(row, template, label, base, size, diagonal, places): verified votes per diagonal."""
    places = found.where(F.size("found") > 0).select("row", F.inline("found"))
    votes = places.join(F.broadcast(grams), ["hash", "gram"])  # the templates, a fixed table
    return votes.groupBy("row", "template", "label", "base", "size", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.collect_set("place").alias("places")  # at most the template's runs
    )


def spans(voted: DataFrame) -> DataFrame:
    """Neighbouring diagonals merged: (row, template, label, base, span, share, best).

    ``best`` is the largest share of any span that has a text word in common, so a notice
    that another one explains better can be told from it.
    """
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > NEIGHBOURS).cast("int"), F.lit(1))
    numbered = voted.withColumn("new", new).withColumn("span", F.sum("new").over(order))
    words = F.explode(F.flatten(F.transform("places", lambda p: F.sequence(p, p + GRAM - 1)))).alias("word")
    keys = ["row", "template", "label", "base", "size", "span"]
    covered = numbered.select(*keys, "diagonal", words).distinct()
    span = Window.partitionBy("row", "template", "span")
    share = F.size(F.collect_set("word").over(span)) / F.col("size")  # one template's words
    placed = covered.withColumn("share", share).withColumn("at", F.col("diagonal") + F.col("word"))
    best = F.max("share").over(Window.partitionBy("row", "at"))
    return placed.withColumn("best", best).groupBy(*keys).agg(
        F.max("share").alias("share"), F.max("best").alias("best")
    )


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    grams = template_grams(spark)
    known = sorted({r["hash"] for r in grams.select("hash").collect()})  # the templates' runs
    found = written(hits(docs, known), "license_hits")
    voted = written(diagonals(found, grams), "diagonals")
    exact = voted.where(F.col("base") & (F.size("places") == F.col("size") - GRAM + 1))
    base = exact.groupBy("row").agg(
        F.count("*").alias("n_base"),
        F.min("diagonal").cast("bigint").alias("first_word"),
        F.max("diagonal").cast("bigint").alias("last_word"),
        F.array_sort(F.collect_set("label")).alias("base_list"),  # labels of the templates
    )
    merged = spans(voted)
    told = (F.col("share") >= COVERED) & (F.col("share") >= F.col("best")) & ~F.col("base")
    own = merged.groupBy("row").agg(
        F.collect_set(F.when(told, F.col("label"))).alias("own_list"),  # labels of the templates
        F.max("share").alias("share"),
    )
    none = F.array().cast("array<string>")
    base_list, own_list = F.coalesce("base_list", none), F.coalesce("own_list", none)
    return (
        found.select("doc_id", "row", "n_words")
        .join(written(base, "base_places"), "row", "left")
        .join(written(own, "own_spans"), "row", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"),
            "first_word",
            "last_word",
            F.array_join(base_list, ",").alias("base_labels"),
            F.array_join(F.array_sort(F.array_union(base_list, own_list)), ",").alias("labels"),
            F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
        )
    )
