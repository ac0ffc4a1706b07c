"""License scans by an exact set-similarity join of templates and text blocks. DataFrame functions only.

Texts are cut into blocks of ``2 * STEP`` words, one every ``STEP`` words, so that a notice of up to ``STEP`` words
lies whole in a block. A template is found where a block holds at least ``CONTAINMENT`` of its distinct words. Nothing
that reaches the threshold is missed:

* words are ordered by how many documents hold them, rarest first, over the whole table;
* prefix filter: a block with enough words of a template holds one of its rarest ``size - needed + 1`` words, so only
  these are joined on, and only texts that hold one are cut into blocks;
* length filter: a block with fewer template words than a template needs is left out;
* positional filter: if the shared word is the ``i``-th of the template and the ``j``-th of the block, at most
  ``1 + min(size - i, length - j)`` words can be shared; for the first shared word this bound holds;
* what is left is counted exactly.

The only broadcast is the index of the templates' rarest words, a hundred rows that no data can add to.

Notices of different licenses may have nearly all words in common. A template that another label's template nearly
contains must find its own words, those the other lacks, in the block, by the same share; one that lies wholly inside
another's is not what a block says that holds the other's own words. Where notices of both stand in one block, only
the fuller one is found.

Short phrases that name a license are counted beside that, at each place where their words stand in a row.

Defined results: null and empty texts have no words, no places and no labels, and score 0. Rows that agree in doc_id
and text get the same labels. Ties in frequency are ordered by the word. Texts of any length are cut whole. Extra columns are left out, whatever they are called.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.llm.common import stored

# Phrases and the labels they stand for.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Notices that the licenses ask to be put on works, and their labels.
TEMPLATES = [
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies",
    ),
    (
        "apache-2",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    (
        "mpl-2",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
]
CONTAINMENT = (4, 5)
STEP = 48
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-case words of a text. Lower-casing letters beyond ASCII as well moves no word border and no ASCII word."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def template_sets(templates: list[tuple[str, str]] = TEMPLATES) -> list[tuple[int, str, list[str], int]]:
    """Number, label, distinct words, and how many of them a block needs."""
    up, down = CONTAINMENT
    sets = [(label, sorted(set(re.split(SEPARATORS, text.lower())) - {""})) for label, text in templates]
    return [(i, label, words, math.ceil(up * len(words) / down)) for i, (label, words) in enumerate(sets)]


def distinguishing(sets: list[tuple[int, str, list[str], int]]) -> dict[int, tuple[list[list[str]], list[list[str]]]]:
    """For each template the groups of words of which a block must hold enough, and those of which it must not.

    They come from the templates of other labels that could be taken for it.
    """
    out = {}
    for number, label, words, needed in sets:
        own, others = [], []
        for _, other, more, _ in sets:
            if other != label and len(set(words) & set(more)) >= needed:
                rest, beyond = sorted(set(words) - set(more)), sorted(set(more) - set(words))
                if rest:
                    own.append(rest)
                else:
                    others.append(beyond)
        out[number] = (own, others)
    return out


def texts(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def places(words: Column, phrase: str) -> Column:
    """Where the phrase's words stand in a row. Only texts that hold the phrase are looked through word by word."""
    parts = phrase.split(" ")
    joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    starts = F.sequence(F.lit(0), F.size(words) - len(parts))
    found = F.filter(starts, lambda i: F.slice(words, i + 1, len(parts)) == texts(parts))
    return F.when(F.contains(joined, F.lit(f" {phrase} ")), found).otherwise(F.array().cast("array<int>"))


def phrase_places(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: number of words, places of phrases, and their labels."""
    rows = docs.withColumn("words", words_of(F.col("text")))
    columns = {f"at{i}": places(F.col("words"), phrase) for i, phrase in enumerate(PHRASES)}
    rows = rows.withColumns(columns)
    everywhere = F.concat(*columns)
    labels = F.array_compact(
        F.array(*[F.when(F.size(c) > 0, F.lit(label)) for c, label in zip(columns, PHRASES.values(), strict=True)])
    )
    return rows.select(
        *docs.columns,
        F.size("words").cast("long").alias("n_words"),
        F.size(everywhere).cast("long").alias("n_base"),
        F.array_min(everywhere).cast("long").alias("first_word"),
        F.array_max(everywhere).cast("long").alias("last_word"),
        labels.alias("base"),
    )


def template_index(docs: DataFrame, sets: list[tuple[int, str, list[str], int]]) -> tuple[list[str], list[tuple]]:
    """The templates' words in order of frequency, and per template its rarest words with their positions.

    The driver gets a row per template word.
    """
    vocabulary = sorted({w for _, _, words, _ in sets for w in words})
    held = docs.select(F.explode(F.array_intersect(words_of(F.col("text")), texts(vocabulary))).alias("word"))
    counts = {r.word: r.n for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    apart = distinguishing(sets)
    index = []
    for number, label, words, needed in sets:
        ranks = sorted(rank[w] for w in words)
        own, others = ([[rank[w] for w in group] for group in groups] for groups in apart[number])
        rarest = enumerate(ranks[: len(ranks) - needed + 1])
        index += [(r, number, label, i + 1, len(ranks), needed, ranks, own, others) for i, r in rarest]
    return order, index


def template_matches(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """All ``(doc_id, text_hash, block, label, containment)`` that reach the threshold, for ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    sets = template_sets(templates)
    order, entries = template_index(docs, sets)
    kinds = "word int, template int, label string, i int, size int, needed int, ranks array<int>, own array<array<int>>, others array<array<int>>"
    index = F.broadcast(spark.createDataFrame(entries, kinds))
    least = min(needed for *_, needed in sets)
    prefix = sorted({order[e[0]] for e in entries})
    ranks = F.map_from_arrays(texts(order), F.array(*map(F.lit, range(len(order)))))

    words = F.col("words")
    last = F.greatest(F.ceil((F.size(words) - STEP) / STEP).cast("int"), F.lit(1)) - 1
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_intersect(F.slice(words, i * STEP + 1, 2 * STEP), texts(order)))
    blocks = (
        docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"))
        .filter(F.arrays_overlap("words", texts(prefix)))
        .select("doc_id", "text_hash", F.posexplode(cut).alias("block", "held"))
        .filter(F.size("held") >= least)
        .withColumn("held", F.array_sort(F.transform("held", lambda w: ranks[w])))
    )
    shared = blocks.select("*", F.posexplode("held").alias("j0", "word")).join(index, "word")
    bound = 1 + F.least(F.col("size") - F.col("i"), F.size("held") - F.col("j0") - 1)
    candidates = shared.filter((F.size("held") >= F.col("needed")) & (bound >= F.col("needed")))
    overlap = F.size(F.array_intersect("held", "ranks"))
    up, down = CONTAINMENT
    holds = lambda group: F.size(F.array_intersect(F.col("held"), group)) * down >= F.size(group) * up
    return (
        candidates.withColumn("overlap", overlap)
        .filter(F.col("overlap") >= F.col("needed"))
        .filter(F.forall("own", holds) & ~F.exists("others", holds))
        .select("doc_id", "text_hash", "block", "label", (F.col("overlap") / F.col("size")).alias("containment"))
        .distinct()
    )


def scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: counts and places of phrases, labels of phrases, all labels, and a score.

    The score is 1 with a phrase, else the highest containment of a template that was found, else 0.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = stored(
        template_matches(rows)
        .groupBy("doc_id", "text_hash")
        .agg(F.array_sort(F.collect_set("label")).alias("more"), F.max("containment").alias("containment")),
        "licenses",
    )
    base = (
        phrase_places(rows)
        .withColumn("text_hash", F.xxhash64("text"))
        .drop("text")
        .withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    )
    found = found.withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63)))).drop("doc_id")
    both = base.join(found, ["id", "text_hash"], "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return both.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )
