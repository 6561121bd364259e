"""License notices in text: fixed phrases, and an exact set-similarity join with notice templates."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PLAIN_WORD

# Base phrases (words that stand consecutively) and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Short notices of well-known licenses, as published.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
           "associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted "
           "provided that the following conditions are met",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "lgpl": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring "
               "rights to this work",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "isc": "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee "
           "is hereby granted",
}
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONTAINMENT = 0.8
#: A notice may be stretched to so many times its words; no window is shorter than the second figure.
STRETCH, WINDOW = 4, 64


def words(text: Column) -> Column:
    """Lower-cased words of letters, digits and characters beyond ASCII (only A-Z change case)."""
    lower = F.translate(text, UPPER, UPPER.lower())
    return F.array_remove(F.split(lower, BETWEEN), "")


def template_words(templates: dict[str, str]) -> dict[str, list[str]]:
    """Distinct words of each template, by the same rule as for texts."""
    table = str.maketrans(UPPER, UPPER.lower())
    return {name: sorted(set(re.findall(PLAIN_WORD, t.translate(table)))) for name, t in templates.items()}


def _places(text: Column, tokens: Column, phrase: str) -> Column:
    """Starts (from 0) of a phrase among the words. Words are only gone through where the text shows the phrase."""
    parts = phrase.split()
    last = F.size(tokens) - len(parts)
    hits = F.filter(F.sequence(F.lit(0), last),
                    lambda i: F.slice(tokens, i + 1, len(parts)) == F.array(*[F.lit(p) for p in parts]))
    shown = text.rlike("(?i)" + r"[^A-Za-z0-9\x80-\x{10FFFF}]+".join(parts))
    return F.when(shown & (last >= 0), hits).otherwise(F.array().cast("array<int>"))


def phrase_places(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: (key, n_words, places), places an array of (start, label) of the base phrases."""
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("k"), content.alias("t")).withColumn("w", words(F.col("t")))

    def labelled(phrase: str, label: str) -> Column:
        return F.transform(_places(F.col("t"), F.col("w"), phrase),
                           lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))

    each = [labelled(*pair) for pair in PHRASES]
    return rows.select(F.col("k").alias(key), F.size("w").cast("long").alias("n_words"),
                       F.array_sort(F.concat(*each)).alias("places"), F.xxhash64("t").alias("_text"))


def token_frequencies(docs: DataFrame, text: str, vocabulary: list[str]) -> DataFrame:
    """In how many documents each word of the templates occurs, over the whole table: (token, n)."""
    content = F.coalesce(F.col(text), F.lit(""))
    wanted = F.array(*[F.lit(v) for v in vocabulary])
    return (docs.select(F.explode(F.array_intersect(wanted, words(content))).alias("token"))
            .groupBy("token").agg(F.count("*").alias("n")))


def prefixes(sets: dict[str, list[str]], frequency: dict[str, int], containment: float) -> dict[str, tuple]:
    """Per template: its words from the rarest to the most frequent, the overlap that is needed, and the length
    of the prefix of which a match must hold at least one word."""
    out = {}
    for name, tokens in sets.items():
        ordered = sorted(tokens, key=lambda t: (frequency.get(t, 0), t))
        need = max(1, math.ceil(containment * len(ordered) - 1e-9))
        out[name] = (ordered, need, len(ordered) - need + 1)
    return out


def window_of(template: str) -> int:
    """Words of the windows a template is looked for in: the first of 64, 128, 256, ... that holds it stretched."""
    table = str.maketrans(UPPER, UPPER.lower())
    size = WINDOW
    while size < STRETCH * len(re.findall(PLAIN_WORD, template.translate(table))):
        size *= 2
    return size


def notice_matches(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None,
                   containment: float = CONTAINMENT) -> DataFrame:
    """Every (text block, template) where some window in the block holds enough of the template's words.

    Returns (key, _text, template, start, end, overlap, containment) with the best window of each block (the first of
    equal ones): ``_text`` is a hash of the text, positions count words from 0, the end is exclusive. The length of the
    windows follows from the template, see ``window_of``. Blocks are twice as long and overlap by half, so every window
    of the text lies in a block.
    Exact join by prefix filter: words are ordered by their frequency in the whole table, rarest first; a block
    with the needed overlap must hold one of the template's first words. Blocks with fewer of the words than
    needed fall to the length filter; the place of the shared word in the template bounds what can still be
    shared (positional filter). In what remains the windows are gone through. The template side is a stated list;
    no rows are shuffled by text.
    """
    templates = TEMPLATES if templates is None else templates
    sets = {n: t for n, t in template_words(templates).items() if t}
    size = {n: window_of(templates[n]) for n in sets}
    vocabulary = sorted({t for tokens in sets.values() for t in tokens})
    frequency = {r["token"]: r["n"] for r in token_frequencies(docs, text, vocabulary).collect()}
    rows = [(token, size[name], name, place, len(ordered), need, ordered)
            for name, (ordered, need, length) in prefixes(sets, frequency, containment).items()
            for place, token in enumerate(ordered[:length])]
    starts = docs.sparkSession.createDataFrame(
        rows, "token string, win int, template string, place int, m int, need int, ordered array<string>")
    tokens = docs.select(F.col(key).alias("k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("t"),
                         words(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    groups = []
    for win in sorted(set(size.values())):
        first = F.array(*[F.lit(t) for t in sorted({r[0] for r in rows if r[1] == win})])
        every = F.array(*[F.lit(t) for t in sorted({t for n, x in sets.items() if size[n] == win for t in x})])
        spots = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - win - 1), F.lit(win))
        groups.append((win, first, every, F.when(F.arrays_overlap("w", first), spots)))
    blocks = None
    for win, first, every, spots in groups:
        own = (tokens.select("k", "t", "w", F.explode(spots).alias("at"))
               .select("k", "t", "at", F.slice("w", F.col("at") + 1, 2 * win).alias("b"))
               .withColumn("hit", F.array_intersect("b", every))
               .select("k", "t", "at", "b", "hit", F.lit(win).alias("win"), F.explode(F.array_intersect("hit", first)).alias("token")))
        blocks = own if blocks is None else blocks.union(own)
    pairs = blocks.join(F.broadcast(starts), ["token", "win"])
    before = F.size(F.array_intersect(F.slice("ordered", 1, F.col("place")), "hit"))
    likely = (pairs.filter(F.size("hit") >= F.col("need"))
              .filter(before + F.col("m") - F.col("place") >= F.col("need"))
              .filter(F.size(F.array_intersect("ordered", "hit")) >= F.col("need")))
    shown = F.filter(F.transform("b", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda h: F.array_contains("ordered", h["x"]))
    best = F.array_max(F.transform("shown", lambda h: F.struct(F.size(F.array_distinct(F.transform(
        F.filter("shown", lambda g: (g["i"] >= h["i"]) & (g["i"] < h["i"] + F.col("win"))), lambda g: g["x"]))).alias("overlap"),
        (-h["i"]).alias("i"))))
    found = (likely.select("k", "t", "at", "b", "win", "template", "m", "need", shown.alias("shown")).distinct()
             .withColumn("best", best).filter(F.col("best.overlap") >= F.col("need")))
    start = F.col("at") - F.col("best.i")
    return found.select(
        F.col("k").alias(key), F.col("t").alias("_text"), "template", start.alias("start"),
        F.least(start + F.col("win"), F.col("at") + F.size("b")).alias("end"), F.col("best.overlap").alias("overlap"),
        (F.col("best.overlap") / F.col("m")).alias("containment"))


def find_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None,
                  containment: float = CONTAINMENT) -> DataFrame:
    """One row per document: (key, n_words, places, notices, score).

    ``places`` are the base phrases (start, label), ``notices`` the distinct templates found with their best
    containment (label, containment); ``score`` is the best containment, 1 with a base phrase, 0 without either.
    NULL text counts as empty: no words, empty arrays. Rows that repeat key and text get the same result each.
    """
    best = (notice_matches(docs, key, text, templates, containment)
            .groupBy(F.col(key).alias("_k"), F.col("_text").alias("_t"), "template")
            .agg(F.max("containment").alias("c"))
            .groupBy("_k", "_t")
            .agg(F.array_sort(F.collect_list(F.struct(F.col("template").alias("label"), F.col("c").alias("containment"))))
                 .alias("notices")))
    rows = phrase_places(docs, key, text)
    joined = rows.join(best, rows[key].eqNullSafe(best["_k"]) & (rows["_text"] == best["_t"]), "left")
    notices = F.coalesce("notices", F.array().cast("array<struct<label:string,containment:double>>"))
    score = F.when(F.size("places") > 0, F.lit(1.0)).otherwise(
        F.coalesce(F.array_max(F.transform(notices, lambda x: x["containment"])), F.lit(0.0)))
    return joined.select(key, "n_words", "places", notices.alias("notices"), score.alias("score"))
