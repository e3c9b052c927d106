"""License scans by diagonal voting, in built-in functions alone.

The words of a text are hashed in runs of k; all runs are joined to the positions at which the
templates have them. A hit votes for the diagonal (place in the text less place in the template)
of its template. Neighbouring diagonals, which a word more or less leads to, are merged; a merged
diagonal is a finding if its votes and the span they cover fit the length of the template, and
no better one overlaps it. Copies of a short template may lie on neighbouring diagonals: a merged
diagonal that spans too much is split where it goes back in the template.

Besides, phrases are looked up: places where all their words stand in a row.

The templates are a fixed list, so that their table is small whatever the corpus; the texts are
read once and only hits and one row per document are shuffled. The votes of a hot template are
spread by document.

Cases: a NULL or empty text has no words and no labels, NULL places and score 0; repeated rows are
scanned each; ids may be NULL or repeated; texts of any length, and words of any alphabet, work.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.words import text_or_empty

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 3
# Diagonals this near are one finding: so many words may be put in or left out in between.
MERGED = 4
# Part of a template's runs that a finding needs, and how far it may be stretched.
LEAST_SHARE = 0.6
MOST_STRETCH = 1.5
# Characters of templates up to which their table goes to every task.
MOST_BROADCAST = 1_000_000

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Usual notices, by label.
TEMPLATES = {
    "agpl": [
        "GNU Affero General Public License as published by the Free Software Foundation",
        "This work is licensed under the GNU Affero General Public License, version 3.",
    ],
    "all-rights-reserved": ["All rights reserved."],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the "
        "License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer.",
        "Licensed under the BSD License.",
        "Released under the BSD License.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or "
        "neighboring rights to this work."
    ],
    "gpl-2": ["This work is licensed under the GNU General Public License, version 2."],
    "gpl-3": [
        "This work is licensed under the GNU General Public License, version 3.",
        "under the terms of the GNU General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies."
    ],
    "lgpl": ["GNU Lesser General Public License as published by the Free Software Foundation"],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}


def license_words(text: Column) -> Column:
    """Words of letters, digits and all characters beyond ASCII, A to Z in lower case."""
    lower = F.translate(text_or_empty(text), UPPER, UPPER.lower())
    return F.array_remove(F.split(lower, SEPARATORS), "")


def _run_hashes(words: Column, n: Column) -> Column:
    """Hashes of the runs of GRAM words, in order; fewer words have none."""
    return F.when(
        n >= GRAM,
        F.transform(
            F.sequence(F.lit(0), n - GRAM),
            lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(GRAM))),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def template_positions(spark: SparkSession, templates: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row per run of words of each template: template, label, place, run and number of runs."""
    numbered = [(label, text) for label, texts in sorted(templates.items()) for text in texts]
    rows = spark.createDataFrame(
        [(i, label, text) for i, (label, text) in enumerate(numbered)], "template int, label string, text string"
    )
    rows = rows.select("template", "label", license_words(F.col("text")).alias("words"))
    rows = rows.select("template", "label", "words", F.size("words").alias("n"))
    runs = rows.select("template", "label", "n", _run_hashes(F.col("words"), F.col("n")).alias("runs"))
    return runs.select(
        "template", "label", F.size("runs").alias("n_runs"), F.posexplode("runs").alias("place", "run")
    )


def _stands_at(words: Column, phrase: str, i: Column) -> Column:
    first, *rest = phrase.split(" ")
    found = F.get(words, i) == first
    for k, word in enumerate(rest, 1):
        found = found & (F.get(words, i + k) == word)
    return found


def scan_licenses(
    docs: DataFrame,
    templates: Mapping[str, Sequence[str]] = TEMPLATES,
    phrases: Mapping[str, str] = PHRASES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document with what is found in it.

    id, n_words, n_base, first_word, last_word, base_labels, labels, score, and findings: spans of
    words (from, to) with their label and the part of the template's runs that is there.
    """
    spark = docs.sparkSession
    texts = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), license_words(F.col(text_col)).alias("words")
    )
    words, n = F.col("words"), F.size("words")
    # All phrases end in words that few texts have; the others need no search.
    lasts = sorted({phrase.split(" ")[-1] for phrase in phrases})
    some_last = F.lit(False)
    for last in lasts:
        some_last = some_last | F.array_contains(words, last)
    labels = sorted(set(phrases.values()))

    def any_phrase(i: Column, label: str | None = None) -> Column:
        found = F.lit(False)
        for phrase, own in sorted(phrases.items()):
            if label in (None, own):
                found = found | F.coalesce(_stands_at(words, phrase, i), F.lit(False))
        return found

    places = F.when(
        some_last & (n > 0), F.filter(F.sequence(F.lit(0), n - 1), lambda i: any_phrase(i))
    ).otherwise(F.array().cast("array<int>"))
    texts = texts.select("row", "id", "words", n.alias("n"), places.alias("places"))

    def named(label: str) -> Column:
        return F.when(F.exists("places", lambda i: any_phrase(i, label)), F.lit(label))

    base = [named(label) for label in labels]
    texts = texts.select(
        "row",
        F.struct(
            F.col("id"),
            F.col("n").cast("bigint").alias("n_words"),
            F.size("places").cast("bigint").alias("n_base"),
            F.array_min("places").cast("bigint").alias("first_word"),
            F.array_max("places").cast("bigint").alias("last_word"),
            F.concat_ws(",", *base).alias("base_labels"),
        ).alias("head"),
        _run_hashes(words, F.col("n")).alias("runs"),
    )
    # Before a text's runs stands a row for the text itself, so that the texts are read but once.
    head_type = texts.schema["head"].dataType
    heads = F.array(F.struct(F.lit(None).cast("int").alias("at"), F.lit(None).cast("bigint").alias("run"), F.col("head")))
    runs = F.transform(
        "runs", lambda run, i: F.struct(i.alias("at"), run.alias("run"), F.lit(None).cast(head_type).alias("head"))
    )
    rows = texts.select("row", F.inline(F.concat(heads, runs)))
    positions = template_positions(spark, templates)
    # Spark does not know how small a table made of a list is.
    if sum(len(text) for texts_ in templates.values() for text in texts_) <= MOST_BROADCAST:
        positions = F.broadcast(positions)
    hits = rows.join(positions, "run", "left").filter(F.col("label").isNotNull() | F.col("head").isNotNull())
    votes = hits.select(
        "row", "head", "template", "label", "n_runs", "at", (F.col("at") - F.col("place")).alias("diagonal")
    )
    # The rows of the texts themselves have no template.
    by_diagonal = votes.groupBy("row", "head", "template", "label", "n_runs", "diagonal").agg(
        F.count(F.lit(1)).alias("votes"), F.min("at").alias("begin"), F.max("at").alias("end")
    )
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(order) > MERGED
    islands = by_diagonal.withColumn("starts", F.coalesce(apart.cast("int"), F.lit(0)))
    islands = islands.withColumn("island", F.sum("starts").over(order))
    length = F.col("n_runs") + GRAM - 1
    most = F.ceil(length * MOST_STRETCH)
    # A diagonal belongs to one copy; the next copy begins no later in the template than it ends.
    whole = Window.partitionBy("row", "template", "island")
    in_text = whole.orderBy("begin", "diagonal")
    stretched = F.max("end").over(whole) + GRAM - F.min("begin").over(whole) > most
    back = F.col("begin") - F.col("diagonal") <= F.lag(F.col("end") - F.col("diagonal")).over(in_text)
    copies = islands.withColumn("next_copy", F.coalesce((stretched & back).cast("int"), F.lit(0)))
    copies = copies.withColumn("copy", F.sum("next_copy").over(in_text))
    merged = copies.groupBy("row", "head", "template", "label", "n_runs", "island", "copy").agg(
        F.sum("votes").alias("votes"), F.min("begin").alias("begin"), (F.max("end") + GRAM).alias("end")
    )
    share = F.least(F.col("votes") / F.col("n_runs"), F.lit(1.0))
    verified = (share >= LEAST_SHARE) & (F.col("end") - F.col("begin") <= most)
    finding = F.struct(
        F.col("begin").cast("bigint").alias("from_word"),
        F.col("end").cast("bigint").alias("to_word"),
        "label",
        share.alias("share"),
        "votes",
        "template",
    )
    found = merged.groupBy("row").agg(
        F.first("head", ignorenulls=True).alias("head"),
        F.sort_array(F.collect_list(F.when(F.col("label").isNotNull() & verified, finding))).alias("findings"),
    )
    # Templates resemble each other: of findings at one place the best stays.
    def rank(f: Column) -> Column:
        return F.struct(f["share"], f["votes"], -f["template"])

    def beaten(f: Column) -> Column:
        return F.exists(
            "findings",
            lambda g: (g["from_word"] < f["to_word"]) & (f["from_word"] < g["to_word"]) & (rank(g) > rank(f)),
        )

    found = found.withColumn("findings", F.filter("findings", lambda f: ~beaten(f)))
    base_labels = F.filter(F.split("head.base_labels", ","), lambda x: x != "")
    own = F.transform("findings", lambda f: f["label"])
    labels_all = F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, own))), ",")
    best = F.coalesce(F.array_max(F.transform("findings", lambda f: f["share"])), F.lit(0.0))
    return found.select(
        F.col("head.id").alias(id_col),
        "head.n_words",
        "head.n_base",
        "head.first_word",
        "head.last_word",
        "head.base_labels",
        labels_all.alias("labels"),
        F.greatest(best, F.when(F.col("head.n_base") > 0, 1.0).otherwise(0.0)).alias("score"),
        "findings",
    )
