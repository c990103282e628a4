"""License scans: places of license phrases, and an exact set-similarity join of text blocks with license templates.

Method of the join: a text is covered by overlapping blocks of BLOCK words, STEP apart, so every passage of up to STEP words lies
whole in one block. Blocks and templates are sets of tokens, ordered by how rare a token is in all documents. A block can hold a
share t of a template of n tokens only if it has one of the n - ceil(t n) + 1 rarest of them (prefix), at least ceil(t n)
tokens (length), and enough tokens left behind the first common one (position). What passes is compared in full. A match gives its
label only if the words that tell the license from others stand in the block one after the other. Everything is DataFrame
expressions; texts are never shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

BLOCK, STEP, THRESHOLD = 64, 32, 0.8
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# What stands between words. Splitting there gives the same words as looking for each, several times faster.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Phrases and the labels they give (fixed values).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Passages of public licenses, their labels and the phrase that tells them from other licenses (fixed values); none is longer than
# STEP words, and its phrase is part of it.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "associated documentation files"),
    ("mit", "released under the mit license", "mit license"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("lgpl", "redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lesser general public license"),
    ("agpl", "redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "endorse or promote products"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse public license"),
    ("bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "accompanying documentation covered"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use", "authors be held liable"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all rights", "dedicated the work"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "commons attribution 4"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "attribution sharealike"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "attribution noncommercial"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("ofl", "this font software is licensed under the sil open font license version 1 1", "open font license"),
)


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lowered(text), GAP), "")


def places(words: Column, phrase: str) -> Column:
    """Starts of all places where the words of the phrase stand one after the other."""
    parts = phrase.split()

    def stands(offset: int):
        return lambda i: F.get(words, i + offset) == parts[offset]

    at = F.sequence(F.lit(0), F.size(words) - 1)
    for offset in reversed(range(len(parts))):
        at = F.filter(at, stands(offset))
    return F.when(F.array_contains(words, parts[-1]), at).otherwise(F.array().cast("array<int>"))


def texts_array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def template_order(df: DataFrame, text: str, templates) -> dict[str, int]:
    """Documents that hold each template token: one row per token of the templates, so a bounded number reaches the driver."""
    vocabulary = sorted({token for _, passage, _ in templates for token in passage.split()})
    held = df.select(F.explode(F.array_intersect(words_of(F.col(text)), texts_array(vocabulary))).alias("token")).groupBy("token").count().collect()
    counts = {row["token"]: row["count"] for row in held}
    return {token: i for i, token in enumerate(sorted(vocabulary, key=lambda token: (counts.get(token, 0), token)))}


def matches(df: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Every block that holds the threshold's share of a template: (*keys, block, label, template, containment, told).

    `told` says whether the template's telling phrase stands in the block, word after word: the share alone may be met without the
    one word that names the license, and in short templates by words that lie scattered.

    Null and empty texts have no blocks; repeated rows give repeated matches; other columns are not read.
    """
    spark, order = df.sparkSession, template_order(df, text, templates)
    indexed, prefix, least = [], set(), BLOCK
    for number, (label, passage, telling) in enumerate(templates):
        tokens = sorted(set(passage.split()), key=order.__getitem__)
        need = math.ceil(threshold * len(tokens) - 1e-9)
        least = min(least, need)
        for i, token in enumerate(tokens[:len(tokens) - need + 1]):
            prefix.add(token)
            indexed.append((token, number, label, i, len(tokens), need, tokens, f" {telling} "))
    index = spark.createDataFrame(indexed, "token string, template int, label string, i int, n int, need int, tokens array<string>, telling string")
    ranked = texts_array(sorted(order, key=order.__getitem__))
    words = F.col("_words")
    split = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(words) - 1) / STEP), F.lit(0))), lambda b: F.struct(b.alias("block"), F.array_intersect(ranked, F.slice(words, (b * STEP + 1).cast("int"), BLOCK)).alias("held")))
    fit = F.filter(split, lambda b: (F.size(b["held"]) >= least) & F.arrays_overlap(b["held"], texts_array(sorted(prefix))))
    # Blocks only exist where the text holds a prefix token at all. As a filter of its own this would be pushed below the words and split the text twice.
    fit = F.when(F.arrays_overlap(words, texts_array(sorted(prefix))), fit)
    rows = df.select(*keys, words_of(F.col(text)).alias("_words"))
    # Words hold no blanks, so a phrase stands in the block where it stands in the joined words.
    spoken = F.concat(F.lit(" "), F.array_join(F.slice(words, (F.col("_b.block") * STEP + 1).cast("int"), BLOCK), " "), F.lit(" "))
    blocks = rows.select(*keys, "_words", F.explode(fit).alias("_b")).select(*keys, "_b.block", "_b.held", spoken.alias("spoken"))
    # `held` is in global order, rarest first, so a token's place in it is its rank in the block.
    rare = blocks.select(*keys, "block", "held", "spoken", F.posexplode("held").alias("j", "token")).where(F.col("token").isin(sorted(prefix)))
    pairs = rare.join(F.broadcast(index), "token").where((F.size("held") >= F.col("need")) & (1 + F.least(F.size("held") - F.col("j"), F.col("n") - F.col("i")) - 1 >= F.col("need")))
    # Of the tokens that block and template share, the first alone speaks for the pair.
    first = F.array_position(F.col("held"), F.get(F.array_intersect("held", "tokens"), F.lit(0))) - 1
    common = F.size(F.array_intersect("held", "tokens"))
    return pairs.where((F.col("j") == first) & (common >= F.col("need"))).select(*keys, "block", "label", "template", (common / F.col("n")).alias("containment"),
                                                                             F.contains("spoken", "telling").alias("told"))


def scan(df: DataFrame, text: str = "text", key: str = "doc_id", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: words, phrase places and the labels of phrases and of templates whose telling phrase is there.

    Null text counts as empty: no words, no labels, score 0. Rows are told apart by key and text, so repeated keys keep their own
    labels and repeated rows stay; a null key is a key like any other; extra columns are not read.
    """
    docs = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    identity = F.xxhash64(F.lit(1), "_key", "_text").alias("_mark")
    found = matches(docs.select("_key", "_text", identity), "_text", ("_key", "_mark"), templates, threshold).where("told")
    found = found.groupBy("_key", "_mark").agg(F.collect_set("label").alias("_labels"), F.max("containment").alias("_best"))
    starts = docs.select("_key", identity, words_of(F.col("_text")).alias("_words"))
    at = {phrase: places(F.col("_words"), phrase) for phrase in PHRASES}
    marked = starts.select("_key", "_mark", F.size("_words").cast("bigint").alias("n_words"), *[places_.alias(f"_at{i}") for i, places_ in enumerate(at.values())])
    every = F.flatten(F.array(*[F.col(f"_at{i}") for i in range(len(at))]))
    base = F.filter(F.array(*[F.when(F.size(f"_at{i}") > 0, F.lit(label)) for i, label in enumerate(PHRASES.values())]), lambda label: label.isNotNull())
    narrow = marked.select("_key", "_mark", "n_words", F.size(every).cast("bigint").alias("n_base"), F.array_min(every).cast("bigint").alias("first_word"), F.array_max(every).cast("bigint").alias("last_word"), base.alias("_base"))
    both = narrow.join(found.withColumnsRenamed({"_key": "_other", "_mark": "_mark2"}), (F.col("_mark") == F.col("_mark2")) & F.col("_key").eqNullSafe(F.col("_other")), "left")
    labels = F.array_union("_base", F.coalesce("_labels", F.array().cast("array<string>")))
    return both.select(F.col("_key").alias(key), "n_words", "n_base", "first_word", "last_word",
                       F.array_join(F.array_sort(F.array_distinct("_base")), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("labels"),
                       F.when(F.size("_base") > 0, 1.0).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"))
