"""License scan: an exact set-similarity join of text blocks with license templates, in DataFrame functions only.

A template is a set of words; a block of text holds it if it has at least `LEAST_HELD` of them (containment). Blocks are
windows of 2 * L words at every L-th word, where L is the size class of a template, the least power of 4 from 16 on that
is not below its words: any L words in a row lie whole in one block. The join has the three filters of set-similarity
joins over words ordered by how few texts of the corpus hold them (rarest first):

- length: a block with fewer template words than any template of its class needs is no candidate;
- prefix: a pair with the needed overlap o shares one of the block's first ``|B| - o + 1`` words and of the template's
  first ``|T| - o + 1``, so only these are joined, in an equi-join by word with the index of the templates;
- position: what follows the shared word in both must still allow the overlap.

Pairs that pass are compared exactly. Words that no template has cannot add to an overlap, so they are left out of a
block before it is ordered. Blocks are cut within their row, and only those with candidates are exploded; links are
kept by the digest of the text, once for any number of copies, and joined to the rows by it. So no text is shuffled, a
hot text is one link, and rows of one text are a skewed side that adaptive execution can split. The templates are a
parameter of the program and checked to be few (`MOST_TEMPLATES`), so their index is broadcast.

Null and empty texts, and those without words, have no words, places, links or labels, and score 0. Repeated rows give
repeated rows. A very long text is one row, its work linear in its words. An empty table gives no rows. Words that are
equally frequent are ordered by themselves. Other columns of the table are never touched, so no name can clash.
"""

from __future__ import annotations

import string
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterglass.llm.common import table

#: What stands between words: every byte below 0x80 that is no digit or lower-case letter.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Share of a template's words that a block must hold.
LEAST_HELD = 0.8
#: Templates are broadcast with their words.
MOST_TEMPLATES = 1000
FIRST_CLASS, CLASS_STEP = 16, 4

# Phrases whose words must stand in a row, with their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# Public license notices, with their labels.
TEMPLATES = [
    ("Released under the MIT License.", "mit"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "mit"),
    ("Licensed under the Apache License, Version 2.0.", "apache"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "apache"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gpl"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl"),
]


@dataclass(frozen=True)
class Template:
    number: int
    label: str
    words: tuple[str, ...]
    size_class: int
    needed: int


def plain_words(text: str) -> list[str]:
    """The words of a template."""
    flat = "".join(c if c.isdigit() or c.isalpha() or ord(c) > 127 else " " for c in text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
    return flat.split(" ")


def templates_of(given: list[tuple[str, str]], held: float = LEAST_HELD) -> list[Template]:
    """Templates as sets of words, with their class and the overlap that they need; those without words are left out."""
    if not 0 < held <= 1:
        raise ValueError("the share of a template's words is above 0 and at most 1")
    if len(given) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    out = []
    for number, (text, label) in enumerate(given):
        words = [w for w in plain_words(text) if w]
        if words:
            size = FIRST_CLASS
            while size < len(words):
                size *= CLASS_STEP
            distinct = tuple(dict.fromkeys(words))
            out.append(Template(number, label, distinct, size, ceil(round(held * len(distinct), 9))))
    return out


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none for null."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(F.regexp_replace(lowered, SEPARATORS, " "), " "), "")


def once(value: Column, use) -> Column:
    """``use`` of a value that is computed once a row, however often it occurs there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def literal_words(words) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def rarest_first(df: DataFrame, text: Column, templates: list[Template]) -> list[str]:
    """All words of templates by the number of texts that hold them, rarest first; ties by the word."""
    known = sorted({w for t in templates for w in t.words})
    counts = df.select(F.explode(F.array_intersect(literal_words(known), words_of(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    seen = {r["word"]: r["n"] for r in counts.collect()}  # a row for each word of a template at most
    return sorted(known, key=lambda w: (seen.get(w, 0), w))


def license_links(df: DataFrame, text: Column, templates: list[Template], digest: Column) -> DataFrame:
    """(digest, template, label, held): each text, by its digest, with each template that one of its blocks holds, and the greatest share held."""
    rank = {w: k for k, w in enumerate(rarest_first(df, text, templates))}
    ordered = {t.number: sorted(t.words, key=rank.__getitem__) for t in templates}
    classes = sorted({t.size_class for t in templates})
    least = {c: min(t.needed for t in templates if t.size_class == c) for c in classes}

    def of_class(words: Column, c: int) -> Column:
        known = literal_words(sorted({w for t in templates if t.size_class == c for w in t.words}, key=rank.__getitem__))
        starts = F.when(F.size(words) > 0, F.sequence(F.lit(1), F.size(words), F.lit(c)))
        cut = F.transform(starts, lambda s: F.struct(F.lit(c).alias("size_class"), F.array_intersect(known, F.slice(words, s, 2 * c)).alias("block")))
        return F.coalesce(F.filter(cut, lambda b: F.size(b["block"]) >= least[c]), F.array().cast("array<struct<size_class:int,block:array<string>>>"))

    def blocks(words: Column) -> Column:
        """Of every block that may hold a template, (size class, its template words rarest first)."""
        return F.array_distinct(F.concat(*[of_class(words, c) for c in classes]))

    index = [(t.size_class, w, at + 1, t.number, t.label, len(t.words), t.needed, ordered[t.number]) for t in templates for at, w in enumerate(ordered[t.number][: len(t.words) - t.needed + 1])]
    schema = "size_class int, word string, at int, template int, label string, size int, needed int, words array<string>"
    cut = df.select(digest.alias("digest"), F.explode(once(words_of(text), blocks)).alias("b")).select("digest", "b.*")
    prefix = cut.withColumn("n", F.size("block")).select("*", F.posexplode(F.slice("block", F.lit(1), F.col("n") - _least(least) + 1)).alias("place", "word"))
    probed = prefix.join(F.broadcast(df.sparkSession.createDataFrame(index, schema)), ["size_class", "word"])
    place = F.col("place") + 1
    near = probed.where((F.col("n") >= F.col("needed")) & (place <= F.col("n") - F.col("needed") + 1) & (F.least(F.col("n") - place, F.col("size") - F.col("at")) + 1 >= F.col("needed")))
    overlap = near.withColumn("overlap", F.size(F.array_intersect("block", "words"))).where("overlap >= needed")
    return overlap.groupBy("digest", "template", "label").agg(F.max(F.col("overlap") / F.col("size")).alias("held"))


def _least(least: dict[int, int]) -> Column:
    """The least overlap that a template of the row's class needs."""
    return F.coalesce(*[F.when(F.col("size_class") == c, F.lit(n)) for c, n in least.items()])


def phrase_places(words: Column, phrases: list[tuple[str, str]]) -> Column:
    """Where each phrase's words stand in a row: (label, first word), from 0; in order of place."""

    def found(i: Column) -> Column:
        labels = []
        for phrase, label in phrases:
            same = F.lit(True)
            for k, w in enumerate(phrase.split(" ")):
                same = same & (F.get(words, i + k) == w)
            labels.append(F.when(same, F.lit(label)))
        return F.transform(F.array_compact(F.array(*labels)), lambda x: F.struct(x.alias("label"), i.alias("word")))

    every = F.transform(F.sequence(F.lit(0), F.size(words) - 1), found)
    last = sorted({p.split(" ")[-1] for p, _ in phrases})
    empty = F.array().cast("array<struct<label:string,word:int>>")
    return F.when(F.arrays_overlap(words, literal_words(last)), F.flatten(every)).otherwise(empty)


def scan_licenses(df: DataFrame, text: Column, *keys: str, templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES, held: float = LEAST_HELD) -> DataFrame:
    """Per row: ``keys``, ``n_words``, ``places`` of phrases (label, word), and ``links`` (template, label, held) to templates, by number."""
    known = templates_of(templates, held)
    digest = F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)
    base = once(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), phrase_places(w, phrases).alias("places")))
    rows = df.select(F.struct(*[df[f"`{k}`"] for k in keys]).alias("keys"), digest.alias("digest"), base.alias("base")).select("keys", "digest", "base.*")
    if not known:
        return rows.select("keys.*", "n_words", "places", F.array().cast("array<struct<template:int,label:string,held:double>>").alias("links"))
    links = license_links(df, text, known, digest).groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("template", "label", "held"))).alias("links"))
    joined = rows.join(links, "digest", "left")
    return joined.select("keys.*", "n_words", "places", F.coalesce("links", F.array().cast(links.schema["links"].dataType)).alias("links"))


def op11_license_scan(spark, sf_dir: str) -> DataFrame:
    """All documents: words, places of the base phrases, their labels, all labels, and the greatest share of a template held (0 without a link)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_licenses(docs, F.col("text"), "doc_id")
    base, linked = F.col("places.label"), F.col("links.label")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    at = F.col("places.word").cast("array<long>")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, linked)).alias("labels"), F.coalesce(F.array_max(F.col("links.held")), F.lit(0.0)).alias("score"),
    )


def scan_sql() -> str:
    """SQL for `op11_license_scan` that compares every block with every template."""
    known = templates_of(TEMPLATES)
    array = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    rows = ", ".join(f"({t.number}, '{t.label}', {t.size_class}, {t.needed}, {len(t.words)}, {array(t.words)})" for t in known)
    classes = ", ".join(f"({c})" for c in sorted({t.size_class for t in known}))
    phrases = ", ".join(f"({array(p.split(' '))}, '{label}')" for p, label in PHRASES)
    return rf"""WITH words AS (SELECT rowid AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{SEPARATORS}'), lambda x: x <> '') AS w FROM (SELECT row_number() OVER () AS rowid, * FROM documents)),
templates(template, label, c, needed, size, t) AS (VALUES {rows}), classes(c) AS (VALUES {classes}), phrases(p, label) AS (VALUES {phrases}),
blocks AS (SELECT r, c, unnest(list_transform(range(0, len(w), c), lambda s: list_distinct(w[s + 1:s + 2 * c]))) AS b FROM words, classes),
links AS (SELECT r, label, max(len(list_intersect(b, t))::DOUBLE / size) AS held FROM blocks JOIN templates USING (c) WHERE len(list_intersect(b, t)) >= needed GROUP BY r, template, label),
linked AS (SELECT r, list(label) AS labels, max(held) AS score FROM links GROUP BY r),
places AS (SELECT r, label, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1:i + len(p)] = p)) AS i FROM words, phrases WHERE list_contains(w, p[-1])),
based AS (SELECT r, list(label) AS labels, count(*) AS n, min(i) AS first_word, max(i) AS last_word FROM places GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(based.n, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
coalesce(array_to_string(list_sort(list_distinct(based.labels)), ','), '') AS base_labels,
coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(based.labels, []), coalesce(linked.labels, [])))), ','), '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM words LEFT JOIN based USING (r) LEFT JOIN linked USING (r)"""
