"""License scans by a positional index of rare words, in DataFrame and SQL functions only.

Templates are notices of licences and short phrases that name one. One pass counts in how many texts each of their words occurs. The index then holds, for each
template, its RARE rarest words (highest inverse document frequency; for a phrase all of its words) with their places in the template. A text is looked up by
those of its words that the index has: a word at place i of the text that stands at place p of a template speaks for a start at i - p. Where enough of a
template's indexed words agree on a start (for a phrase all of them, for a notice half) the stretch from there on is a candidate; it is a
match if all key phrases that the template demands stand in it, word by word. A notice may have words added, left out or changed, as long
as half of its rare words still keep their distances; the key phrases are then looked for SLACK words around, too.

Everything about one text is an expression over its own row: no shuffle but for the word counts, which are summed before and are at most a row for each
word of the templates; that is also what the driver collects. Starts are sorted, not compared in pairs, so that a text full of
licence words costs no more than sorting them.

Edge cases: null texts are empty and have no matches; words are case-folded for A to Z only; repeated rows are scanned each for itself; overlapping places count each;
of templates with equal labels each match is reported. A template word that no text has is not indexed. An empty table gives no rows. Only the two named columns are read.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import let, lower_ascii

#: Between words: everything in ASCII but digits and small letters, after case folding.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Indexed words of a notice.
RARE = 8
#: Words before and after a notice's place in which its key phrases may stand.
SLACK = 10


@dataclass(frozen=True)
class Template:
    """A notice or, without key phrases, a phrase of which every word counts."""

    label: str
    text: str
    keys: tuple[str, ...] = ()

    @property
    def words(self) -> list[str]:
        return self.text.split()


#: Phrases and the labels of them.
PHRASES = [Template("mit", "mit license"), Template("apache", "apache license"), Template("gpl", "general public license")]

#: Well-known notices (punctuation left out), with what none of their versions lacks.
NOTICES = [
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template(
        "apache-2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied",
        ("may not use this file except in compliance with the license", "without warranties or conditions of any kind"),
    ),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("general public license version 3",)),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by "
        "the free software foundation either version 3 of the license or at your option any later version",
        ("free software you can redistribute it and or modify it", "general public license"),
    ),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
        "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this "
        "permission notice appear in all copies",
        ("for any purpose with or without fee is hereby granted",),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
]


def words_of(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), GAP), lambda w: w != "")


def word_frequencies(docs: DataFrame, templates: list[Template], text_col: str = "text") -> dict[str, int]:
    """In how many texts each word of the templates occurs: at most a row for each such word is collected."""
    vocabulary = F.array(*map(F.lit, sorted({w for t in templates for w in t.words})))
    held = docs.select(F.explode(F.array_intersect(words_of(F.col(text_col)), vocabulary)).alias("word"))
    return {r["word"]: r["count"] for r in held.groupBy("word").count().collect()}


def postings(template: Template, frequency: dict[str, int]) -> list[tuple[str, int]]:
    """The template's indexed words with their places, rarest words first."""
    rare = sorted({w for w in template.words if frequency.get(w)}, key=lambda w: (frequency[w], w))
    rare = rare[:RARE] if template.keys else rare
    return [(w, p) for w in rare for p, x in enumerate(template.words) if x == w]


def needed(template: Template) -> int:
    """How many postings have to agree on a start."""
    if not template.keys:
        return len(template.words)
    return max(2, -(-min(RARE, len(set(template.words))) // 2))


def _matches(template: Template, k: int, index: list[tuple[str, int]], words: Column, places: Column) -> Column:
    """The template's verified places in one text: an array of (template, start, share)."""
    need, size, slack = needed(template), len(template.words), SLACK if template.keys else 0
    none = F.array().cast("array<struct<template:int,start:int,share:double>>")
    listed = F.from_json(F.lit(json.dumps([{"w": w, "p": p} for w, p in index])), "array<struct<w:string,p:int>>")
    own = F.array(*map(F.lit, sorted(set(template.words))))
    spoken = F.transform(listed, lambda x: F.transform(F.filter(places, lambda s: s["w"] == x["w"]), lambda s: s["i"] - x["p"]))

    def agreed(starts: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(starts) - need), lambda i: F.get(starts, i) == F.get(starts, i + (need - 1)))
        return F.array_distinct(F.transform(first, lambda i: F.get(starts, i)))

    def checked(start: Column) -> Column:
        low = F.greatest(start - slack, F.lit(0))
        around = F.slice(words, low + 1, start + (size + slack) - low)

        def judged(stretch: Column) -> Column:
            line = F.concat(F.lit(" "), F.array_join(stretch, " "), F.lit(" "))
            holds = F.forall(F.array(*[F.lit(f" {key} ") for key in template.keys or (template.text,)]), lambda key: F.contains(line, key))
            share = F.size(F.array_intersect(own, stretch)) / len(set(template.words))
            return F.when(holds, F.struct(F.lit(k).alias("template"), start.alias("start"), share.alias("share")))

        return let(around, judged)

    found = let(F.array_sort(F.flatten(spoken)), lambda starts: F.when(F.size(starts) >= need, F.filter(F.transform(agreed(starts), checked), lambda m: m.isNotNull())))
    return F.coalesce(found, none) if len(index) >= need else none


def scan_licenses(docs: DataFrame, templates: list[Template], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, matches) for each row; a match is (template: its number, start: the first word's number, share of the template's words that stand there)."""
    frequency = word_frequencies(docs, templates, text_col)
    index = [postings(t, frequency) for t in templates]
    indexed = F.array(*map(F.lit, sorted({w for x in index for w, _ in x}))).cast("array<string>")

    def searched(words: Column) -> Column:
        def of(held: Column) -> Column:
            places = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda s: F.array_contains(held, s["w"]))
            every = let(places, lambda at: F.flatten(F.array(*[_matches(t, k, x, words, at) for k, (t, x) in enumerate(zip(templates, index, strict=True))])))
            return F.when(F.size(held) > 1, every)

        return F.struct(F.size(words).cast("long").alias("n"), let(F.array_intersect(words, indexed), of).alias("matches"))

    rows = docs.select(F.col(id_col).alias("id"), let(words_of(F.col(text_col)), searched).alias("s"))
    none = F.array().cast("array<struct<template:int,start:int,share:double>>")
    return rows.select("id", F.col("s.n").alias("n_words"), F.coalesce("s.matches", none).alias("matches"))


def label_names(matches: Column, templates: list[Template]) -> Column:
    """The distinct labels of matches, sorted and joined by commas."""
    names = F.array(*[F.lit(t.label) for t in templates])
    return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: F.get(names, m["template"])))), ",")
