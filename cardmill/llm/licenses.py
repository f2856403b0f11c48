"""License scans: base phrases, and an exact set-similarity join of text blocks with license templates.

Built-in functions only. Blocks are the windows of ``BLOCK_WORDS`` words at every word of a text. A block
matches a template if it holds at least ``CONTAINED_PERCENT`` of the template's distinct words. A block that does not start with a
word of a template holds no more of these than the one that starts at the next such word, so the others need not be looked at.

The words of the templates are counted over all texts and ordered by that, rare ones
first. In this order the first word that a block and a matching template share is
among the first n - need + 1 words of the template and m - need + 1 of the block, where need is
the overlap asked for; these prefixes are joined. A pair then needs a
block that is long enough, and enough words after the place of the match on both sides, before its overlap is counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .tables import A_TO_Z, BROADCAST_KEYS, stored

BLOCK_WORDS = 64
CONTAINED_PERCENT = 90

# Words that must stand one after the other, and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Sentences of public licenses and how works refer to them, as words.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("public-domain", "this work has been released into the public domain"),
    ("reserved", "no part of this publication may be reproduced distributed or transmitted in any form or by any means without the prior written permission of the publisher"),
)

_NOT_WORD = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
NO_ID = -(2**63)  # stands for a missing id in joins


def _lowered(text: Column) -> Column:
    return F.translate(text, A_TO_Z, A_TO_Z.lower())


def _lowered_fast(text: Column) -> Column:
    """As ``_lowered`` for what is ASCII; two letters outside it would become ASCII otherwise."""
    return F.when(text.rlike("[İK]"), _lowered(text)).otherwise(F.lower(text))


def _words(lowered: Column) -> Column:
    return F.regexp_extract_all(lowered, F.lit(f"[^{_NOT_WORD}]+"), F.lit(0))


def _phrase_starts(words: Column, phrase: str) -> Column:
    parts = phrase.split()

    def stands(at: Column) -> Column:
        hit = words[at] == parts[0]
        for k, part in enumerate(parts[1:], 1):
            hit = hit & (words[at + k] == part)
        return hit

    some = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), stands)
    return F.when(F.size(words) >= len(parts), some).otherwise(F.expr("cast(array() as array<int>)"))


def base_phrases(words: Column, own: Column) -> Column:
    """``(n_base, first_word, last_word, base_labels)`` of the words of a text, of which ``own`` are those in the vocabulary."""
    holds = lambda phrase: F.size(F.array_intersect(own, F.array(*map(F.lit, phrase.split())))) == len(phrase.split())
    none = F.expr("cast(array() as array<int>)")
    starts = {
        label: F.when(holds(phrase), _phrase_starts(words, phrase)).otherwise(none) for phrase, label in BASE_PHRASES.items()
    }
    return F.struct(*(places.alias(label) for label, places in starts.items()))


def _base_columns(starts: Column) -> list[Column]:
    places = [starts[label] for label in BASE_PHRASES.values()]
    everywhere = F.concat(*places)
    labels = F.array(*(F.when(F.size(starts[label]) > 0, label) for label in BASE_PHRASES.values()))
    return [
        F.size(everywhere).cast("long").alias("n_base"),
        F.array_min(everywhere).cast("long").alias("first_word"),
        F.array_max(everywhere).cast("long").alias("last_word"),
        F.array_sort(F.filter(labels, lambda x: x.isNotNull())).alias("base_labels"),
    ]


def _need(n: int) -> int:
    return -(-CONTAINED_PERCENT * n // 100)


def template_matches(docs: DataFrame, kept: DataFrame, templates=TEMPLATES) -> DataFrame:
    """``(of, mark, label, contained)`` from ``(of, mark, text)``: the best match of each label, of every block of every text.

    ``kept (of, mark, own)`` has the words of the templates that each text holds.
    """
    sets = [(label, sorted(set(text.split()))) for label, text in templates]
    if any(len(text.split()) > BLOCK_WORDS for _, text in templates):
        raise ValueError("a template is longer than a block")
    vocabulary = sorted({word for _, words in sets for word in words})
    literal = lambda words: F.array(*map(F.lit, words))
    lowered = _words(_lowered_fast(F.col("text")))

    # At most one row for each word of the templates.
    words = kept.select(F.explode(F.array_intersect("own", literal(vocabulary))).alias("word"))
    counted = dict(words.groupBy("word").count().collect())
    ordered = sorted(vocabulary, key=lambda w: (counted.get(w, 0), w))
    rank = {word: i for i, word in enumerate(ordered)}
    index = []
    for t, (_, words) in enumerate(sets):
        ranks = sorted(rank[w] for w in words)
        need = _need(len(ranks))
        index += [(r, t, i, len(ranks), need) for i, r in enumerate(ranks[: len(ranks) - need + 1])]
    prefixes = sorted({ordered[r] for r, *_ in index})
    spark = docs.sparkSession
    index = spark.createDataFrame(index, "rank int, template int, place int, n int, need int")
    table = spark.createDataFrame(
        [(t, label, sorted(rank[w] for w in words)) for t, (label, words) in enumerate(sets)],
        "template int, label string, ranks array<int>",
    )

    def places(wanted: list[str]) -> Column:
        found = F.transform("words", lambda w, i: F.when(F.array_contains(literal(wanted), w), i))
        return F.filter(found, lambda i: i.isNotNull())

    # Blocks that start with a word of a template and hold one of a prefix, each set of words once a text.
    near = F.filter("starts", lambda s: F.exists("hits", lambda h: (h >= s) & (h < s + BLOCK_WORDS)))
    held = F.transform(near, lambda s: F.array_sort(F.array_intersect(F.slice("words", s + 1, F.lit(BLOCK_WORDS)), literal(ordered))))
    some = stored(kept.filter(F.arrays_overlap("own", literal(prefixes))).select("of", "mark").distinct(), "likely")
    if 2 * some.count() <= BROADCAST_KEYS:
        some = F.broadcast(some)
    worded = docs.join(some, ["of", "mark"], "left_semi").select("of", "mark", lowered.alias("words"))
    worded = worded.select("*", F.explode(F.array(F.struct(places(ordered).alias("starts"), places(prefixes).alias("hits")))).alias("p"))
    worded = worded.select("of", "mark", "words", "p.starts", "p.hits").filter(F.size("hits") > 0)
    blocks = worded.select("of", "mark", F.explode(F.array_distinct(held)).alias("block"))
    ranked = F.array_sort(F.transform("block", lambda w: F.array_position(literal(ordered), w).cast("int") - 1))
    placed = blocks.select("of", "mark", ranked.alias("block"))
    tokens = placed.select("of", "mark", "block", F.posexplode("block").alias("at", "rank"))
    m = F.size("block")
    pairs = tokens.join(F.broadcast(index), "rank").filter(
        (m >= F.col("need"))
        & (F.col("at") <= m - F.col("need"))
        & (1 + F.least(F.col("n") - 1 - F.col("place"), m - 1 - F.col("at")) >= F.col("need"))
    )
    overlap = F.size(F.array_intersect("block", "ranks"))
    checked = pairs.join(F.broadcast(table), "template").filter(overlap >= F.col("need"))
    return checked.groupBy("of", "mark", "label").agg(F.max(overlap / F.col("n")).alias("contained"))


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: counts and places of base phrases, all labels, and a score.

    ``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score)``; label lists are sorted arrays. The score is 1 with a base phrase, else the highest share of a
    template that a block holds if it is enough to match, else 0. A null or empty text has no words and
    no labels. A row is known by its id and its text, so rows that
    repeat both have equal results, and a missing id is an id like others. Extra columns are
    ignored. Labels of templates are found in any case of letters, A-Z only.
    """
    words = F.coalesce(F.col(text).cast("string"), F.lit(""))
    named = F.col(doc_id).cast("long")
    rows = docs.select(
        named.alias("doc_id"), F.coalesce(named, F.lit(NO_ID)).alias("of"), F.xxhash64(words).alias("mark"), words.alias("text")
    )
    vocabulary = sorted({w for _, text in TEMPLATES for w in text.split()} | {w for p in BASE_PHRASES for w in p.split()})
    own = F.array_intersect("words", F.array(*map(F.lit, vocabulary)))
    # The one pass over all words; what it gives is narrow.
    first = rows.withColumn("words", _words(_lowered_fast(F.col("text")))).withColumn("own", own)
    first = stored(
        first.select(
            "doc_id", "of", "mark", F.size("words").cast("long").alias("n_words"), "own",
            base_phrases(F.col("words"), F.col("own")).alias("starts"),
        ),
        "words",
    )
    best = template_matches(rows.select("of", "mark", "text"), first.filter(F.size("own") > 0).select("of", "mark", "own"))
    best = best.groupBy("of", "mark").agg(F.collect_set("label").alias("found"), F.max("contained").alias("contained"))
    base = first.select("doc_id", "of", "mark", "n_words", *_base_columns(F.col("starts")))
    joined = base.join(best, ["of", "mark"], "left")
    found = F.coalesce("found", F.expr("cast(array() as array<string>)"))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
        F.array_sort(F.array_union("base_labels", found)).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("contained", F.lit(0.0))).alias("score"),
    )
