"""License scan by diagonal voting, in DataFrame operations only.

Every rolling word k-gram of every text is joined, by its 64-bit hash and then its words, with the
k-grams of the templates. Matches of one text and template whose text place minus template place agree lie
on a diagonal; votes are counted per diagonal, neighbouring diagonals are grouped and within a group
merged where they follow each other (they differ by words inserted or left out), and a merged span is a finding if enough of
the template's words are verified in it. The templates are a constant of bounded size, so their side is
broadcast; the texts are read once, and only matches are shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm._text import LOWER, UPPER

#: Words of one k-gram.
K = 2
#: Diagonals of one template may differ by so many words and still be one span.
NEIGHBOUR = 4
#: The part of a template's words that a span must show.
COVER = 0.8

#: What separates words in lower-cased text.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases of the base labels.
PHRASES = {
    "gpl": "gnu general public license",
    "apache": "apache license",
    "cc-by": "cc by",
    "mit": "mit license",
}

# Sentences of public licence texts and notices, with labels of their own.
TEXTS = {
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-text": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "gpl-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mit-notice": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "mpl-text": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}


def words_of(text: str) -> list[str]:
    return [w for w in re.split(BETWEEN, text.translate(str.maketrans(UPPER, LOWER))) if w]


def template_grams(spark: SparkSession, k: int = K) -> DataFrame:
    """template, base, size in words, place and gram of every k-gram of every template."""
    rows = []
    for base, group in ((True, PHRASES), (False, TEXTS)):
        for label, text in group.items():
            words = words_of(text)
            rows += [(label, base, len(words), i, " ".join(words[i : i + k])) for i in range(len(words) - k + 1)]
    values = ", ".join(f"('{a}', {str(b).lower()}, {n}, {i}, '{g}')" for a, b, n, i, g in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(template, base, size, place, gram)")


def words_column(text_col: str) -> "F.Column":
    """The words of a text as an array; null and empty texts have none."""
    lowered = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, BETWEEN), "")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, cover: float = COVER, neighbour: int = NEIGHBOUR) -> DataFrame:
    """One row per row of `docs`: id, n_words and `found`, an array of verified spans.

    A span has template, base, first, last (words from 0) and the part of the template verified. Base
    spans are whole phrases; others need `cover` of the template. Repeated rows are scanned apart.
    """
    grams = F.col("words")
    for i in range(1, k):
        grams = F.zip_with(grams, F.slice("words", F.lit(i + 1), F.greatest(F.size("words"), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    grams = F.slice(grams, F.lit(1), F.greatest(F.size("words") - (k - 1), F.lit(0)))
    texts = docs.select(F.col(id_col), F.monotonically_increasing_id().alias("rid"), words_column(text_col).alias("words"))
    # A last gram of no words stands once in every text and meets its own template: no text is lost.
    texts = texts.select(id_col, "rid", F.size("words").cast("long").alias("n_words"), F.posexplode(F.concat(grams, F.array(F.lit("")))).alias("at", "gram"))
    one = docs.sparkSession
    template = template_grams(one, k).unionByName(one.sql("SELECT '' template, false base, 0 size, 0 place, '' gram"))
    template = template.withColumn("h", F.xxhash64("gram")).withColumnRenamed("gram", "template_gram")
    hits = texts.join(F.broadcast(template), (F.xxhash64("gram") == F.col("h")) & (F.col("gram") == F.col("template_gram")))
    key = ["rid", F.col(id_col), "n_words", "template", "base", "size"]
    votes = hits.groupBy(*key, (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.min("at").alias("first"), (F.max("at") + k - 1).alias("last"), F.sort_array(F.collect_set("place")).alias("places")
    )
    # A base phrase lies on one diagonal, whole; others are grouped by nearness of the diagonals, and by place within a group.
    base = F.col("base") & (F.size("places") == F.col("size") - (k - 1))
    votes = votes.where((F.col("template") == "") | base | ~F.col("base"))
    near = Window.partitionBy("rid", "template").orderBy("diagonal")
    votes = votes.withColumn("before", F.lag("diagonal").over(near))
    far = F.col("before").isNull() | (F.col("diagonal") - F.col("before") > neighbour)
    votes = votes.withColumn("near", F.sum(F.when(far, 1).otherwise(0)).over(near))
    order = Window.partitionBy("rid", "template", "near").orderBy("first", "diagonal")
    votes = votes.withColumn("end", F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    breaks = F.col("base") | F.col("end").isNull() | (F.col("first") > F.col("end") + F.col("size"))
    votes = votes.withColumn("span", F.sum(F.when(breaks, 1).otherwise(0)).over(order))
    spans = votes.groupBy("rid", id_col, "n_words", "template", "base", "size", "near", "span").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("places")
    )
    # Verified words of the template: those of any k-gram found.
    seen = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + k - 1)))))
    spans = spans.withColumn("part", F.least(F.lit(1.0), seen / F.greatest("size", F.lit(1))))
    good = F.when((F.col("template") != "") & (F.col("part") >= cover), F.struct("template", "base", "first", "last", "part"))
    return spans.groupBy("rid", id_col, "n_words").agg(F.array_sort(F.collect_list(good)).alias("found")).drop("rid")


def report(docs: DataFrame) -> DataFrame:
    """Per document the base phrases' places and all labels found."""
    found = scan(docs.select("doc_id", "text"))
    base = F.filter("found", lambda s: s["base"])
    label = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["template"]))), ",")
    texts = F.filter("found", lambda s: ~s["base"])
    score = F.coalesce(F.array_max(F.transform("found", lambda s: s["part"])), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["first"])).cast("long").alias("last_word"),
        label(base).alias("base_labels"),
        label(F.col("found")).alias("labels"),
        score.alias("score"),
        F.size(texts).cast("long").alias("n_texts"),
    )
