"""License scans by diagonal voting, in DataFrame functions only.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. Every rolling 2-gram
of a document is hashed and joined to the positions of the templates' 2-grams. Hits vote for
their diagonal (place in the document minus place in the template); a diagonal's votes are the
set of template positions that it holds, so a phrase that repeats votes once. A diagonal that
holds all 2-grams of a phrase is a place where the phrase stands. For notices each diagonal
merges with those up to ``NEAR`` words to its right (words put in move later hits there; words
left out move them to the left, where the merge begins): the union of their positions is a span,
which is verified by the share of the template's positions that it holds. A span reaches over
``NEAR`` diagonals and no farther, however many lie side by side, so its hits stand in the
template's order but for ``NEAR`` words.

The templates are fixed, few and of at most 63 words (a longer notice is several templates), so
their table is broadcast. Each hit is checked against a second hash of the same 2-gram. Nothing
is grouped across documents, so a passage that many documents share makes no large group;
repeats within one document count as places of their own.

Cases: null text counts as empty; a text with fewer than two words has no hit; rows that share
a doc_id are told apart by a hash of the text, and equal rows by their count.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

# ---- fixed values: base phrases and their labels, as the contract states them ----
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# ---- fixed values: passages of public licenses and their usual notices ----
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-2.0"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "mit"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "gpl"),
    ("you should have received a copy of the gnu general public license along with this program", "gpl"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("mozilla public license v 2 0", "mpl-2.0"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl-2.0"),
)
#: A notice's span must hold this share of its 2-grams.
SHARE = 0.8
#: Diagonals that a span reaches over, besides its first.
NEAR = 3

_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Array of the words of a text."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, _BREAK), lambda w: w != "")


def template_grams() -> list[tuple]:
    """One row a 2-gram of each template: both words, template, at (place in it), grams (its number), base, label."""
    rows = []
    for number, (phrase, label) in enumerate((*BASE, *NOTICES)):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", phrase)
        rows += [(a, b, number, i, len(w) - 1, number < len(BASE), label) for i, (a, b) in enumerate(zip(w, w[1:]))]
    return rows


def templates(spark: SparkSession) -> DataFrame:
    """The 2-grams by their two hashes."""
    table = spark.createDataFrame(template_grams(), "a string, b string, template int, at int, grams int, base boolean, label string")
    return table.select(F.xxhash64("a", "b").alias("h"), F.hash("a", "b").alias("again"), "template", "at", "grams", "base", "label")


def hits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_id, row_hash, n_words, and per hit: template, diagonal, at, grams, base, label (null for a document's own row)."""
    text = F.col(text_col)
    tokenised = docs.select(F.col(id_col).alias("row_id"), F.xxhash64(text).alias("row_hash"), words(text).alias("w"))
    # the number of words is taken here: asked for behind the generator, it would make every hit carry the whole array
    tokenised = tokenised.withColumn("n_words", F.size("w").cast("long"))
    grams = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("w") - 1, F.lit(1))),
        lambda i: F.struct((i - 1).alias("place"), F.xxhash64(F.get("w", i - 1), F.get("w", i)).alias("h"), F.hash(F.get("w", i - 1), F.get("w", i)).alias("again2")),
    )
    own = F.array(F.struct(F.lit(-1).alias("place"), F.lit(None).cast("long").alias("h"), F.lit(None).cast("int").alias("again2")))
    rolled = tokenised.select("row_id", "row_hash", "n_words", F.inline(F.concat(own, grams)))
    found = rolled.join(F.broadcast(templates(docs.sparkSession)), "h", "left")
    found = found.where((F.col("place") == -1) | (F.col("again") == F.col("again2")))
    return found.select("row_id", "row_hash", "n_words", "template", (F.col("place") - F.col("at")).alias("diagonal"), "at", "grams", "base", "label")


def spans(found: DataFrame) -> DataFrame:
    """Verified spans: row_id, row_hash, template, label, base, start (of the first diagonal), share; own rows pass with template null.

    ``times`` of an own row is the number of equal rows, which all have the same hits.
    """
    key = ["row_id", "row_hash", "n_words"]
    votes = found.groupBy(*key, "template", "label", "base", "grams", "diagonal").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("places"), F.count(F.lit(1)).alias("times"))
    near = W.partitionBy(*key, "template").orderBy("diagonal").rangeBetween(0, NEAR)
    merged = votes.withColumn("held", F.when(F.coalesce("base", F.lit(True)), F.col("places")).otherwise(F.bit_or("places").over(near)))
    share = F.bit_count("held") / F.col("grams")
    least = F.when(F.col("base"), 1.0).otherwise(SHARE)
    return merged.withColumn("share", share).withColumn("start", F.col("diagonal")).where(F.col("template").isNull() | (F.col("share") >= least))


def license_report(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row a document: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The score is the best share of a template that a span holds (1 where a base phrase stands); labels are those of all spans.
    """
    s = spans(hits(docs, id_col))
    base = F.col("base")
    labels = lambda cond: F.array_join(F.sort_array(F.collect_set(F.when(cond, F.col("label")))), ",")
    out = s.groupBy("row_id", "row_hash", "n_words").agg(
        F.max(F.when(F.col("template").isNull(), F.col("times"))).alias("copies"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("label").isNotNull()).alias("labels"),
        F.coalesce(F.max(F.when(F.col("template").isNotNull(), F.col("share"))), F.lit(0.0)).alias("score"),
    )
    # equal rows come back as often as they were given
    return out.select(F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"), "*").select(
        F.col("row_id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )
