"""License scans by an exact set-similarity join, in DataFrame functions alone (operator 5).

Base: places where the words of a known phrase stand one after the other. Method: a block matches a template if it
contains at least CONTAINMENT of the template's distinct words. Template words are put in one global order, from the rarest to the
most frequent over all documents; a block that contains `need` of a template's n words holds one of the n - need + 1 rarest (prefix
filter), has `need` of the templates' words or more itself (length filter), and the first word that the two share has enough words
after it both in the template and among the block's own template words in that order (positional filter). Blocks meet templates in an equality join on prefix words, and the full sets verify what is left. A block that meets several
templates has the labels of them all, but for a template whose words in the block are also words of another one that it meets with more.

Blocks are the lines, and the words about the end of each line that has words (blank lines and marks lie between): as many at each
side as a template has, so that a notice that is wrapped over any number of lines is found.

The templates are a fixed list of a few lines, so they are broadcast. A null text is read as empty: no words, no labels, score 0.
Rows equal in doc_id and text get equal results. Very long texts are scanned whole; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellon.llm import common

CONTAINMENT = 0.9

# Fixed values of the contract: phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Customary wordings of licence notices and the labels that they stand for.
TEMPLATES = (
    ("Licensed under the Apache License, Version 2.0", "apache-2.0"),
    ("you may not use this file except in compliance with the License", "apache-2.0"),
    ("Released under the MIT License", "mit"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("This work is licensed under the GNU General Public License, version 3", "gpl-3.0"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "gpl"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "lgpl"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl-2.0"),
    ("Licensed under CC BY 4.0", "cc-by-4.0"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc-4.0"),
    ("Licensed under CC BY-SA 4.0", "cc-by-sa-4.0"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by-4.0"),
    ("This is free and unencumbered software released into the public domain", "unlicense"),
    ("Unauthorized copying of this file, via any medium is strictly prohibited", "proprietary"),
)

_WORD = r"0-9A-Za-z\x{80}-\x{10FFFF}"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _as_words(text: str) -> list[str]:
    return [w.decode() for w in common.words(text.encode())]


def phrase_pattern(phrase: str) -> str:
    """Finds a phrase's words with nothing but separators between; ASCII letters in any case."""
    return rf"(?i)(?<![{_WORD}]){rf'[^{_WORD}]+'.join(phrase.split())}(?![{_WORD}])"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(rf"[{_WORD}]+")).cast("long")


def base_columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, dk, n_words, n_base, first_word, last_word and base_labels (array)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("dk"), text.alias("text"))
    # one cheap test spares most texts the phrases' own scans
    some = F.col("text").rlike("|".join(f"(?:{phrase_pattern(p)})" for p, _ in PHRASES))
    out = out.withColumn("some", some).withColumn("n_words", word_count(F.col("text")))
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES:
        pattern = phrase_pattern(phrase)
        parts = F.when(F.col("some"), F.split("text", pattern, -1))
        n = F.coalesce(F.size(parts), F.lit(1)) - 1
        n = F.greatest(n, F.lit(0)).cast("long")
        found = F.col("some") & (n > 0)
        counts.append(n)
        firsts.append(F.when(found, word_count(parts.getItem(0))))
        lasts.append(F.when(found, F.col("n_words") - word_count(F.element_at(parts, -1)) - len(phrase.split())))
        labels.append(F.when(found, F.lit(label)))
    return out.select(
        "doc_id", "dk", "n_words", sum(counts[1:], counts[0]).alias("n_base"), F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"),
        F.array_compact(F.array(*labels)).alias("base_labels"),
    )


def template_order(docs: DataFrame, text_col: str, templates=TEMPLATES) -> list[str]:
    """The templates' words from rare to frequent over all documents, ties by word. At most as many rows as templates have words."""
    vocabulary = sorted({w for t, _ in templates for w in _as_words(t)})
    words = F.split(F.translate(F.coalesce(F.col(text_col), F.lit("")), _UPPER, _LOWER), rf"[^{_WORD}]+")
    seen = docs.select(F.explode(F.array_intersect(words, F.array(*map(F.lit, vocabulary)))).alias("w")).groupBy("w").count().collect()
    n = {r["w"]: r["count"] for r in seen}
    return sorted(vocabulary, key=lambda w: (n.get(w, 0), w))


def _words_of(line: Column) -> Column:
    return F.array_remove(F.split(F.translate(line, _UPPER, _LOWER), rf"[^{_WORD}]+"), "")


def _last(words: Column, n: int | Column) -> Column:
    return F.slice(words, F.greatest(F.size(words) - n, F.lit(0)) + 1, n)


def template_matches(docs: DataFrame, id_col: str, text_col: str, templates=TEMPLATES, containment: float = CONTAINMENT, wrapped: bool = False) -> DataFrame:
    """dk, the labels of matching templates (array) and the greatest containment. Blocks are lines and, where wrapped, the words about line ends."""
    spark = docs.sparkSession
    place = {w: k for k, w in enumerate(template_order(docs, text_col, templates))}
    rows, prefix, wanted = [], set(), []
    for k, (text, label) in enumerate(templates):
        words = sorted(set(_as_words(text)), key=place.__getitem__)
        need = -int(-len(words) * round(containment * 100) // 100)
        wanted.append((words, need, len(_as_words(text))))
        for i, w in enumerate(words[: len(words) - need + 1]):
            rows.append((w, k, label, i, need, words, len(_as_words(text))))
            prefix.add(w)
    probes = spark.createDataFrame(rows, "token string, template int, label string, place int, need int, words array<string>, length int")
    prefix = sorted(prefix)
    texts = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("dk"), F.col(text_col).alias("text"))
    some = rf"(?i)(?<![{_WORD}])(?:{'|'.join(prefix)})(?![{_WORD}])"
    lines = texts.select("dk", F.explode(F.split("text", "\n", -1)).alias("line"))
    blocks = lines.where(F.col("line").rlike(some)).select("dk", _words_of(F.col("line")).alias("before"), F.array().cast("array<string>").alias("after"), F.lit(False).alias("seam"))
    if wrapped:
        blocks = blocks.union(seams(texts.where(F.col("text").contains("\n") & F.col("text").rlike(some)), max(n for _, _, n in wanted)))
    blocks = blocks.withColumn("block", F.array_distinct(F.concat("before", "after")))
    # words of no template can be shared with none: a block's others, from rare to frequent
    blocks = blocks.withColumn("held", F.array_intersect(F.array(*map(F.lit, place)), "block")).where(F.size("held") >= min(need for _, need, _ in wanted))
    tokens = blocks.select("dk", "before", "after", "seam", "block", F.size("held").alias("holds"), F.posexplode("held").alias("at", "token"))
    met = tokens.join(F.broadcast(probes), "token")
    room = F.least(F.size("words") - F.col("place"), F.col("holds") - F.col("at"))
    met = met.where((F.col("holds") >= F.col("need")) & (room >= F.col("need")))

    def hits(words: Column, length: Column) -> Column:
        """A template's words in the block; at a line's end, in as many words at each side as it has itself."""
        near = F.concat(_last(F.col("before"), length), F.slice("after", 1, length))
        return F.array_intersect(words, F.when(F.col("seam"), near).otherwise(F.col("block")))

    met = met.withColumn("hit", hits(F.col("words"), F.col("length"))).where(F.size("hit") >= F.col("need")).dropDuplicates(["dk", "before", "after", "seam", "template"])
    # a template is no finding of its own where another one meets the block with these words and further ones
    others = F.array(*(F.struct(F.array(*map(F.lit, words)).alias("words"), F.lit(need).alias("need"), F.lit(n).alias("length")) for words, need, n in wanted))

    def covers(other: Column) -> Column:
        hit = hits(other["words"], F.greatest(other["length"], F.col("length")))
        return (F.size(hit) >= other["need"]) & (F.size(hit) > F.size("hit")) & (F.size(F.array_except("hit", hit)) == 0)

    met = met.withColumn("label", F.when(~F.exists(others, covers), F.col("label")))
    return met.groupBy("dk").agg(F.collect_set("label").alias("found"), F.max(F.size("hit") / F.size("words")).alias("best"))


def seams(texts: DataFrame, n: int) -> DataFrame:
    """dk, and for the end of each line the last n of its words (before) and the n words that follow it, of as many lines as these
    take (after). A text of n words that is wrapped lies about the first line's end that it crosses."""
    lines = F.filter(F.transform(F.split("text", "\n", -1), _words_of), lambda w: F.size(w) > 0)
    ends = F.transform(lines, lambda w: F.struct(F.slice(w, 1, n).alias("head"), _last(w, n).alias("tail")))
    rows = texts.select("dk", ends.alias("ends")).where(F.size("ends") > 1)
    rows = rows.select("dk", "ends", F.explode(F.sequence(F.lit(1), F.size("ends") - 1)).alias("k"))
    after = F.slice(F.flatten(F.slice("ends", F.col("k") + 1, n)["head"]), 1, n)
    return rows.select("dk", F.element_at("ends", F.col("k"))["tail"].alias("before"), after.alias("after"), F.lit(True).alias("seam"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    base = base_columns(docs, id_col, text_col)
    out = base.join(template_matches(docs, id_col, text_col, wrapped=True), "dk", "left")
    none = F.array().cast("array<string>")
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.coalesce("found", none))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base_labels"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
