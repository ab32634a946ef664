"""License scans by an exact set-similarity join with license templates, in DataFrame functions alone.

Words of a text are grouped into overlapping blocks, one starting every half block. A block links with a template when it
holds at least ``THRESHOLD`` of the template's distinct words. A block has ``BLOCK`` words for templates of up to half as
many, and twice as many words for each doubling of a template's length: every verbatim template, however long and wherever
it begins, lies whole in one block, and a long template does not widen the blocks of the short ones. The join orders words by their document frequency in the whole
corpus, rarest first, and then

* prefix: template and block must share one of the first ``k - need + 1`` words of the template, and one of the first
  ``b - need + 1`` of the block (words of no template do not count);
* length: a block with fewer than ``need`` template words is out;
* position: what stands before and after a shared word must still allow ``need`` shared words;

and the survivors are verified by intersection. Every block of every text passes through; a text that does not hold
``need`` words of any template as a whole has no block that does, and is not cut into blocks.

The templates are a parameter; their words are a bounded set. Texts are tokenised once, into a written narrow table.

Cases: null texts are empty; texts without a link or phrase have empty labels, null places and score 0; rows with
equal or null ids are judged each (rows get numbers of their own); an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.run import quoted
from pulseframe.session import materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Well-known notices of public licenses.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
           "associated documentation files (the Software), to deal in the Software without restriction, including "
           "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
           "copies of the Software",
    "apache": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
              "compliance with the License. You may obtain a copy of the License at",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
           "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
           "option) any later version.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
           "that the following conditions are met: Redistributions of source code must retain the above copyright "
           "notice, this list of conditions and the following disclaimer.",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
           "was not distributed with this file, You can obtain one at",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
           "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}
THRESHOLD = 0.8
BLOCK = 160


def words_of(text):
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _template_words(templates: dict[str, str]) -> dict[str, list[str]]:
    """Words of each template that has any, in order."""
    found = {name: re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER))) for name, text in templates.items()}
    return {name: words for name, words in found.items() if words}


def _half_block(length: int, block: int) -> int:
    """Step of the blocks for a template of ``length`` words: half a ``block``, doubled until the template fits in it."""
    half = max(block // 2, 1)
    while half < length:
        half *= 2
    return half


def _phrase_at(words, parts: list[str], label: str):
    """The test for one place: cheap tests on the last word come first."""
    last = len(parts) - 1

    def at(word, i):
        tests = [word == parts[-1], i >= last, *(F.get(words, i - last + k) == p for k, p in enumerate(parts[:-1]))]
        return F.when(reduce(lambda a, b: a & b, tests),
                      F.struct((i - last).cast("long").alias("start"), F.lit(label).alias("label")))

    return at


def _phrase_places(words, phrases: dict[str, str]):
    """(start, label) of every place where a phrase's words stand."""
    none = F.array().cast("array<struct<start:bigint,label:string>>")
    found = [none]
    for phrase, label in phrases.items():
        parts = phrase.split()
        present = reduce(lambda a, b: a & b, [F.array_contains(words, p) for p in parts])
        places = F.filter(F.transform(words, _phrase_at(words, parts, label)), lambda x: x.isNotNull())
        found.append(F.when(present, places).otherwise(none))
    return F.concat(*found)


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None,
                 threshold: float = THRESHOLD, block: int = BLOCK, phrases: dict[str, str] | None = None) -> DataFrame:
    """Per document ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``."""
    spark = docs.sparkSession
    running = _template_words(TEMPLATES if templates is None else templates)
    half_of = {name: _half_block(len(words), block) for name, words in running.items()}
    known = {name: sorted(set(words)) for name, words in running.items()}
    needs = {name: math.ceil(threshold * len(words) - 1e-9) for name, words in known.items()}
    vocabulary = sorted({w for words in known.values() for w in words})
    least = min(needs.values(), default=1 << 30)
    split = docs.select(F.col(quoted(doc_id)).alias("__id"), words_of(F.col(quoted(text))).alias("words"))
    in_templates = F.array_intersect("words", F.array(*map(F.lit, vocabulary)).cast("array<string>"))
    base = materialize(
        split.withColumn("common", in_templates)
        .select(F.monotonically_increasing_id().alias("__row"), "__id", F.size("words").cast("long").alias("n_words"),
                _phrase_places(F.col("words"), PHRASES if phrases is None else phrases).alias("places"), "common",
                F.when(F.size("common") >= least, F.col("words")).alias("words")),
        "license-words")
    # document frequencies of the template words, over all documents
    frequency = (base.select(F.explode("common").alias("word")).groupBy("word").agg(F.count("*").alias("df")))
    template_words = spark.createDataFrame(
        [(name, word) for name, words in known.items() for word in words], "template string, word string")
    ordered = (template_words.join(frequency, "word", "left")
               .select("template", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word").alias("token"))
               .groupBy("template").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
               .select("template", F.transform("tokens", lambda t: t["word"]).alias("t_words"),
                       F.size("tokens").alias("k")))
    sizes = [(name, need, half_of[name]) for name, need in needs.items()]
    ordered = ordered.join(spark.createDataFrame(sizes, "template string, need int, half int"), "template")
    lookup = ordered.select("template", "half", "t_words", "k", "need", F.posexplode("t_words").alias("i", "word"))
    lookup = lookup.filter(F.col("i") < F.col("k") - F.col("need") + 1)

    # a block starts every half block, so that each stretch of half a block lies whole in one of them
    def starts(half: int):
        last = F.greatest(F.lit(0), F.ceil((F.col("n_words") - half) / half).cast("int") - 1)
        return F.transform(F.sequence(F.lit(0), last), lambda n: F.struct(F.lit(half).alias("half"), n.alias("number")))

    halves = sorted(set(half_of.values())) or [_half_block(1, block)]
    blocks = (base.filter(F.col("words").isNotNull())
              .select("__row", "words", F.inline(F.concat(*map(starts, halves))))
              .select("__row", "half", "number", F.explode(F.array_intersect(
                  F.slice("words", F.col("number") * F.col("half") + 1, F.col("half") * 2),
                  F.array(*map(F.lit, vocabulary)).cast("array<string>"))).alias("word"))
              .join(frequency, "word")
              .groupBy("__row", "half", "number")
              .agg(F.sort_array(F.collect_list(F.struct("df", "word"))).alias("tokens"))
              .select("__row", "half", F.transform("tokens", lambda t: t["word"]).alias("b_words"),
                      F.size("tokens").alias("b")))
    candidates = (blocks.filter(F.col("b") >= least)
                  .select("__row", "half", "b_words", "b", F.posexplode("b_words").alias("j", "word"))
                  .join(lookup, ["word", "half"])
                  .filter((F.col("b") >= F.col("need")) & (F.col("j") < F.col("b") - F.col("need") + 1)
                          & (F.least("i", "j") + 1 + F.least(F.col("k") - F.col("i") - 1, F.col("b") - F.col("j") - 1)
                             >= F.col("need"))))
    linked = (candidates.withColumn("shared", F.size(F.array_intersect("b_words", "t_words")))
              .filter(F.col("shared") >= F.col("need"))
              .groupBy("__row").agg(F.collect_set("template").alias("found"),
                                    F.max(F.col("shared") / F.col("k")).alias("best")))
    base_labels = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    none = F.array().cast("array<string>")
    return (base.join(linked, "__row", "left").select(
        F.col("__id").alias(doc_id), "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["start"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["start"])).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.coalesce("found", none))), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score")))
