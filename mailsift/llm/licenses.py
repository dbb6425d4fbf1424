"""License scan by diagonal voting.

Templates and texts are cut into rolling grams of k words. A gram's hash that
is joined to a template position votes for the diagonal ``text position -
template position``: an unchanged copy puts all its votes on one diagonal, an
inserted or dropped word moves the rest to a neighbouring one. Diagonals that
lie close together are merged, and a merged run is verified by the share of the
template's words that its matched grams cover, against the words it spans.
All of it is DataFrame functions; every row of a text's hits stays with that
row, so no key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailsift.llm.common import blank, stored

#: Words of a gram of the long templates, and of the exact phrases.
LONG_GRAM, PHRASE_GRAM = 4, 2
#: Words by which neighbouring diagonals may differ.
SHIFT = 8
#: A run is verified if its grams cover this share of both template and span.
LEAST_COVER = 0.6
#: Template grams up to which the template side is broadcast.
BROADCAST_GRAMS = 50_000

#: Phrases that count wherever their words stand consecutively.
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]

#: Openings and notices of common licenses as published.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details"),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("boost", "Distributed under the Boost Software License, Version 1.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("mit", "Released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("apache", "SPDX-License-Identifier: Apache-2.0"),
    ("gpl", "SPDX-License-Identifier: GPL-3.0"),
    ("gpl", "SPDX-License-Identifier: GPL-2.0"),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause"),
]


def words_of(text: Column) -> Column:
    """Words: runs of letters, digits and characters beyond ASCII, lower-cased.

    The Kelvin sign is the one character beyond ASCII that ``lower`` would make
    an ASCII letter; it is moved out of the way, so that only A-Z become a-z.
    """
    low = F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u212b")))
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _grams(words: Column) -> Column:
    """One entry per word, with the words after it; entry 0 stands for the text."""
    later = [F.slice(words, k, F.size(words)) for k in range(2, LONG_GRAM + 1)]
    lead = F.array(F.lit(None).cast("string"))
    return F.arrays_zip(*[F.concat(lead, w).alias(f"w{k}") for k, w in enumerate([words, *later])])


def template_grams(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES) -> tuple[DataFrame, int]:
    """Gram positions of all templates, and at most how many there are.

    Phrases need two words or more, templates as many as a gram has.
    """
    rows = [(n, label, text, False) for n, (label, text) in enumerate(templates)]
    rows += [(len(templates) + n, label, text, True) for n, (label, text) in enumerate(phrases)]
    if not rows:
        rows = [(0, "", "", True)]
    listed = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("template", "label", "text", "exact"), r, strict=True)]) for r in rows])
    t = spark.range(1, numPartitions=1).select(F.inline(listed))
    t = t.withColumn("words", words_of(F.col("text"))).withColumn("k", F.when(F.col("exact"), PHRASE_GRAM).otherwise(LONG_GRAM))
    t = t.withColumn("size", F.size("words")).where("size >= k")
    g = t.select("template", "label", "exact", "size", "k", F.posexplode(_grams(F.col("words"))).alias("at", "g")).where("at between 1 and size - k + 1")
    w = [F.when(F.lit(n) < F.col("k"), F.col(f"g.w{n}")).alias(f"t{n}") for n in range(LONG_GRAM)]
    g = g.select("template", "label", "exact", "size", F.col("k").alias("tk"), (F.col("at") - 1).alias("tpos"), *w)
    return g.withColumn("th", F.xxhash64("t0", "t1", "t2", "t3")), sum(len(r[2]) // 2 + 1 for r in rows)


def _votes(docs: DataFrame, grams: DataFrame, size: int, keep: list[str]) -> DataFrame:
    """A row for each text (``pos`` null) and one for each gram found in it, in
    one pass over the texts, kept in the shared folder with the rows' numbers."""
    # Numbered before the words are dealt out, so that a number is a row's.
    d = docs.select(F.monotonically_increasing_id().alias("id"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), words_of(blank("text")).alias("words"))
    d = d.select("id", "row", F.size("words").cast("long").alias("n_words"), F.posexplode(_grams(F.col("words"))).alias("at", "g"))
    w = [F.col(f"g.w{n}").alias(f"w{n}") for n in range(LONG_GRAM)]
    d = d.select("id", "row", "n_words", (F.col("at") - 1).alias("pos"), *w)
    hashes = F.stack(F.lit(2), F.lit(PHRASE_GRAM), F.xxhash64("w0", "w1"), F.lit(LONG_GRAM), F.xxhash64("w0", "w1", "w2", "w3")).alias("k", "h")
    d = d.select("*", hashes).where((F.col("pos") >= 0) | (F.col("k") == LONG_GRAM))
    side = F.broadcast(grams) if size <= BROADCAST_GRAMS else grams
    same = [F.col(f"t{n}").isNull() | F.col(f"w{n}").eqNullSafe(F.col(f"t{n}")) for n in range(LONG_GRAM)]
    met = (F.col("h") == F.col("th")) & (F.col("k") == F.col("tk"))
    for s in same:
        met = met & s
    d = d.join(side, met, "left").where((F.col("pos") < 0) | F.col("template").isNotNull())
    whole = F.col("pos") < 0
    return stored(d.select("id", F.when(whole, F.col("row")).alias("row"), F.when(whole, F.col("n_words")).alias("n_words"), F.when(~whole, F.col("pos")).alias("pos"), "template", "label", "exact", "size", "tpos"))


def runs(votes: DataFrame) -> DataFrame:
    """Verified spans (id, label, exact, start, end, score) of stored votes."""
    key = ["id", "template"]
    hits = votes.where("pos is not null").withColumn("diagonal", F.col("pos") - F.col("tpos"))
    lines = hits.groupBy(*key, "label", "exact", "size", "diagonal").agg(F.collect_list("tpos").alias("at"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    phrases = lines.where(F.col("exact") & (F.size("at") == F.col("size") - (PHRASE_GRAM - 1)))
    phrases = phrases.select("id", "label", "exact", F.col("lo").alias("start"), (F.col("hi") + PHRASE_GRAM).alias("end"), F.lit(1.0).alias("score"))
    order = W.partitionBy(*key).orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(order) > SHIFT
    lines = lines.where(~F.col("exact")).withColumn("first", F.coalesce(apart, F.lit(True)).cast("int"))
    lines = lines.withColumn("run", F.sum("first").over(order))
    merged = lines.groupBy(*key, "label", "exact", "size", "run").agg(
        F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"), F.min("lo").alias("start"), (F.max("hi") + LONG_GRAM).alias("end")
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda t: F.sequence(t, t + LONG_GRAM - 1)))))
    score = covered / F.greatest(F.col("size"), F.col("end") - F.col("start"))
    merged = merged.withColumn("score", score).where(F.col("score") >= LEAST_COVER)
    return phrases.unionByName(merged.select("id", "label", "exact", "start", "end", "score"))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES, keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``row`` (its kept columns), ``n_words`` and
    ``spans``, an array of (start, end, label, exact, score) in order.

    ``start`` and ``end`` count words from 0, end exclusive. ``exact`` spans are
    the phrases, the others merged runs of a template. Null and empty texts
    have no words and no spans; texts of any length are scanned whole; repeated
    rows each get their result; an empty table gives none. Spans that tie in
    place are ordered by end, then label. Other columns pass through ``row``,
    whatever their names.
    """
    keep = docs.columns if keep is None else keep
    grams, size = template_grams(docs.sparkSession, templates, phrases)
    votes = _votes(docs, grams, size, keep)
    found = runs(votes).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "label", "exact", "score"))).alias("spans"))
    texts = votes.where("pos is null").select("id", "row", "n_words")
    none = F.array().cast(found.schema["spans"].dataType)
    return texts.join(found, "id", "left").select("row", "n_words", F.coalesce("spans", none).alias("spans"))


def labels_of(spans: Column) -> Column:
    """Distinct labels, sorted and joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(spans["label"])), ",")
