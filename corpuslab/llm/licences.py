"""Licence notices by diagonal voting.

All rolling word grams of a text are joined to the places of the same grams in
template notices. A gram votes for the diagonal ``place in text - place in
template``; a notice is a diagonal with many votes. Inserted or left out words
shift it, so neighbouring diagonals are merged before the span is verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Phrases that name a licence by themselves.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Wording of common notices.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met",
    ),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version",
    ),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "This work is licensed under CC BY 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("reserved", "All rights reserved. No part of this publication may be reproduced"),
)

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The same words before A-Z are lowered.
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def once(value: Column, use) -> Column:
    """``use(value)`` as a lambda's variable, so that no inner lambda evaluates ``value`` again."""
    return F.get(F.transform(F.array(value), use), 0)


def rolling_grams(table: DataFrame, words: str, size: int) -> DataFrame:
    """The rows of ``table`` with ``place`` and ``hash`` of each rolling gram of the array ``words``.

    The words are zipped with themselves shifted and exploded, all in generated
    code; a lambda over the places would be interpreted for each of them.
    """
    shifted = [F.col(words)] + [F.slice(words, step + 1, F.greatest(F.size(words), F.lit(1))) for step in range(1, size)]
    zipped = F.arrays_zip(*(column.alias(f"w{step}") for step, column in enumerate(shifted)))
    others = [name for name in table.columns if name != words]
    placed = table.select(*others, F.posexplode(zipped).alias("place", "gram"))
    # The last places are followed by too few words.
    parts = [F.col("gram").getField(f"w{step}") for step in range(size)]
    return placed.filter(parts[-1].isNotNull()).select(*others, "place", F.xxhash64(*parts).alias("hash"))


def phrase_places(words: Column, phrase: str) -> Column:
    parts = phrase.split()

    def search(own: Column) -> Column:
        def stands(at: Column) -> Column:
            found = F.get(own, at) == parts[0]
            for step, part in enumerate(parts[1:], 1):
                found = found & (F.get(own, at + step) == part)
            return found

        last = F.size(own) - len(parts)
        places = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), stands)
        return F.when(last >= 0, places).otherwise(F.array().cast("array<int>"))

    return once(words, search)


def template_grams(spark: SparkSession, templates: tuple[tuple[str, str], ...], size: int) -> DataFrame:
    """``(template, label, total, hash, at)``: a row per gram of every template."""
    rows = [(number, label, text) for number, (label, text) in enumerate(templates)]
    table = spark.createDataFrame(rows, "template int, label string, body string")
    table = table.select("template", "label", words_of(F.col("body")).alias("words"))
    table = table.withColumn("total", F.greatest(F.size("words") - size + 1, F.lit(0)))
    return rolling_grams(table, "words", size).withColumnRenamed("place", "at")


def scan_licences(
    docs: DataFrame,
    size: int = 3,
    drift: int = 2,
    least_cover: float = 0.6,
    least_density: float = 0.5,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Licence phrases and notices of every text.

    Returns per row of ``docs``: ``key``, ``n_words``, the number of phrases
    ``n_base`` and their smallest and largest place ``first_word`` and
    ``last_word`` (null without), ``base_labels``, ``labels`` (phrases and
    notices, sorted, comma-joined), ``score`` (1 for a phrase, else the best
    share of a notice's grams that is there, 0 without one) and ``spans`` of
    the notices. A notice counts when ``least_cover`` of its grams and
    ``least_density`` of the grams of the span vote for diagonals at most
    ``drift`` apart.

    A null or empty text has no word and no label. Rows with the same key and
    text get the same result, one row each. All work is done by SQL functions;
    the templates, a fixed table, are the only thing that is broadcast.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    own = F.col(key).cast("bigint")
    rows = docs.select(own.alias("id"), body.alias("body"), F.xxhash64(own, body).alias("one"), F.hash(body, own).alias("two"))
    # Lowering by Unicode, which is faster, finds all places where a phrase can be.
    low = F.lower("body")
    hint = F.lit(False)
    for phrase, _ in PHRASES:
        words = [low.contains(part) for part in phrase.split()]
        every = words[0]
        for word in words[1:]:
            every = every & word
        hint = hint | every
    # Words are only taken apart again where a phrase can be.
    listed = F.when(hint, words_of(F.col("body"))).otherwise(F.array().cast("array<string>"))
    base = (
        rows.select("id", "one", "two", F.regexp_count("body", F.lit(ANY_CASE_WORD)).cast("bigint").alias("n_words"), listed.alias("words"))
        .select("id", "one", "two", "n_words", *(phrase_places(F.col("words"), p).alias(f"p{i}") for i, (p, _) in enumerate(PHRASES)))
    )
    places = F.concat(*(F.col(f"p{i}") for i in range(len(PHRASES))))
    named = F.array(*(F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(PHRASES)))
    base = base.select(
        "id", "one", "two", "n_words",
        F.size(places).cast("bigint").alias("n_base"),
        F.array_min(places).cast("bigint").alias("first_word"),
        F.array_max(places).cast("bigint").alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(named))).alias("base"),
    )

    spans = notice_spans(rows, size, drift, least_cover, least_density, templates)
    joined = base.join(spans, ["one", "two"], "left")
    method = F.coalesce(F.transform("spans", lambda s: s["label"]), F.array().cast("array<string>"))
    cover = F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0))
    return joined.select(
        F.col("id").alias(key),
        "n_words", "n_base", "first_word", "last_word",
        F.concat_ws(",", "base").alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.concat("base", method)))).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(cover).alias("score"),
        "spans",
    )


def notice_spans(
    rows: DataFrame, size: int, drift: int, least_cover: float, least_density: float, templates: tuple[tuple[str, str], ...]
) -> DataFrame:
    """Verified notices per text ``(one, two, body)``: ``(one, two, spans)``."""
    known = template_grams(rows.sparkSession, templates, size)
    words = F.regexp_extract_all(F.lower("body"), F.lit(WORD), F.lit(0))
    placed = rolling_grams(rows.select("one", "two", words.alias("words")), "words", size)
    votes = (
        placed.join(F.broadcast(known), "hash")
        .groupBy("one", "two", "template", "label", "total", (F.col("place") - F.col("at")).alias("diagonal"), "place")
        .agg(F.min("at").alias("at"))
        .groupBy("one", "two", "template", "label", "total", "diagonal")
        .agg(F.count("*").alias("votes"), F.min("place").alias("first"), F.max("place").alias("last"))
    )
    # The diagonals of one text and template are as many as the text has words, at most.
    along = Window.partitionBy("one", "two", "template").orderBy("diagonal")
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > drift, F.lit(True))
    merged = (
        votes.withColumn("new", new.cast("int"))
        .withColumn("span", F.sum("new").over(along))
        .groupBy("one", "two", "template", "label", "total", "span")
        .agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"))
    )
    cover = F.least(F.col("votes") / F.col("total"), F.lit(1.0))
    dense = F.col("votes") / (F.col("last") - F.col("first") + 1)
    span = F.struct(
        (F.col("first")).cast("bigint").alias("first_word"),
        (F.col("last") + size - 1).cast("bigint").alias("last_word"),
        "label",
        cover.alias("score"),
    )
    return (
        merged.filter((cover >= least_cover) & (dense >= least_density))
        .groupBy("one", "two")
        .agg(F.array_sort(F.collect_list(span)).alias("spans"))
    )
