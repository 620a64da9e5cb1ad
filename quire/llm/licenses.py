"""Licence scan by a positional index of rare tokens, with DataFrame functions only.

Texts are sequences of words (A-Z lower-cased; ASCII characters but letters and digits part words). Base phrases are counted at
all places. Beyond them, templates of licence notices are indexed by their rarest words: the highest inverse document
frequencies over the templates. The rare words of a file look up postings (template, place); words that agree on a template
and on the template's place in the file are hits of one candidate; a candidate with enough of the template's rare words at
that place is accepted if the template's mandatory key phrase stands in the file. Files without any key phrase skip the
look-up, as no template could be accepted there.

Null and empty texts have no words, labels or places, and score 0. Labels are distinct and sorted. Nothing is shuffled.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Base phrases with their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Label, mandatory key phrase and words of the notice.
TEMPLATES = [
    ("gpl", "gnu general public license", "this work is licensed under the gnu general public license version"),
    ("gpl", "gnu general public license", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "gnu affero general public license", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("apache", "apache license", "licensed under the apache license version 2 0"),
    ("mit", "mit license", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("isc", "permission to use copy modify and or distribute this software", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "cc by", "licensed under cc by"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by", "creative commons attribution", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "free and unencumbered software", "this is free and unencumbered software released into the public domain"),
    ("reserved", "all rights reserved", "all rights reserved"),
]
#: Share of a template's rare words that has to stand at one place, and how many of its words are rare.
ENOUGH, RARE = 0.7, 6
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SHIFT = 1 << 40


def index() -> tuple[dict[str, list[tuple[int, int]]], list[int]]:
    """Postings (template, place) of each template's rarest words, and how many rare words each template has."""
    often = Counter(w for _, _, text in TEMPLATES for w in set(text.split()))
    postings: dict[str, list[tuple[int, int]]] = {}
    sizes = []
    for t, (_, _, text) in enumerate(TEMPLATES):
        words = text.split()
        rank = sorted(range(len(words)), key=lambda k: (-math.log(len(TEMPLATES) / often[words[k]]), k))
        for k in rank[:RARE]:
            postings.setdefault(words[k], []).append((t, k))
        sizes.append(min(RARE, len(words)))
    return postings, sizes


def normal(text: Column) -> Column:
    """The words of a text between single blanks, with a blank at either end; a blank for no words."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = F.trim(F.regexp_replace(F.translate(text, upper, lower), _SPLIT, " "))
    return F.when(F.length(words) > 0, F.concat(F.lit(" "), words, F.lit(" "))).otherwise(F.lit(" "))


def _places(words: str, phrase: str) -> str:
    """SQL for the places (words from 0) where the phrase stands in the array words."""
    part = phrase.split()
    test = " AND ".join(f"get({words}, i + {k}) = '{w}'" for k, w in enumerate(part))
    return f"filter(transform({words}, (w, i) -> CASE WHEN w = '{part[0]}' AND {test} THEN cast(i AS BIGINT) END), p -> p IS NOT NULL)"


def _accepted(words: str, text: str) -> str:
    """SQL for the array of (label, share) of the templates accepted in a file."""
    postings, sizes = index()
    cases = " ".join(f"WHEN '{w}' THEN array({', '.join(f'{t * _SHIFT - k + 1024}L' for t, k in found)})" for w, found in sorted(postings.items()))
    votes = f"array_sort(flatten(filter(transform({words}, (w, i) -> transform(CASE w {cases} END, v -> v + i)), x -> x IS NOT NULL)))"
    need = "array(" + ", ".join(str(max(1, math.ceil(ENOUGH * n))) for n in sizes) + ")"
    size = "array(" + ", ".join(f"{n}.0D" for n in sizes) + ")"
    none = "cast(array() AS array<struct<t: INT, share: DOUBLE>>)"
    run = "CASE WHEN s.last = v THEN s.n + 1 ELSE 1 END"
    t = f"cast(v div {_SHIFT} AS INT)"
    step = f"named_struct('last', v, 'n', {run}, 'got', CASE WHEN {run} >= get({need}, {t}) THEN array_union(s.got, array(named_struct('t', {t}, 'share', ({run}) / get({size}, {t})))) ELSE s.got END)"
    runs = f"aggregate({votes}, named_struct('last', -1L, 'n', 0, 'got', {none}), (s, v) -> {step}, s -> s.got)"
    keys = "array(" + ", ".join(f"' {key} '" for _, key, _ in TEMPLATES) + ")"
    labels = "array(" + ", ".join(f"'{label}'" for label, _, _ in TEMPLATES) + ")"
    return f"transform(filter({runs}, x -> contains({text}, get({keys}, x.t))), x -> named_struct('label', get({labels}, x.t), 'share', x.share))"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row of docs(doc_id, text)."""
    rows = docs.select("doc_id", normal(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("norm"))
    keys = sorted({*BASE, *(key for _, key, _ in TEMPLATES)})
    any_ = F.expr(" OR ".join(f"contains(norm, ' {key} ')" for key in keys))
    rows = rows.select("doc_id", (F.length("norm") - F.length(F.translate("norm", " ", "")) - 1).cast("long").alias("n_words"), F.when(any_, F.col("norm")).alias("norm"))
    rows = rows.withColumn("words", F.when(F.col("norm").isNotNull(), F.split(F.trim("norm"), " ")))
    found = ", ".join(f"named_struct('label', '{label}', 'at', {_places('words', phrase)})" for phrase, label in BASE.items())
    rows = rows.withColumn("base", F.expr(f"CASE WHEN words IS NOT NULL THEN filter(array({found}), x -> size(x.at) > 0) END"))
    rows = rows.withColumn("more", F.expr(f"CASE WHEN words IS NOT NULL THEN {_accepted('words', 'norm')} END"))
    at = "flatten(transform(base, x -> x.at))"
    return rows.select(
        "doc_id", "n_words",
        F.expr(f"CASE WHEN base IS NULL THEN 0L ELSE cast(size({at}) AS BIGINT) END").alias("n_base"),
        F.expr(f"array_min({at})").alias("first_word"), F.expr(f"array_max({at})").alias("last_word"),
        F.expr("CASE WHEN base IS NULL THEN '' ELSE array_join(array_sort(array_distinct(transform(base, x -> x.label))), ',') END").alias("base_labels"),
        F.expr("CASE WHEN base IS NULL THEN '' ELSE array_join(array_sort(array_union(transform(base, x -> x.label), transform(more, x -> x.label))), ',') END").alias("labels"),
        F.expr("CASE WHEN size(base) > 0 THEN 1.0D WHEN size(more) > 0 THEN array_max(transform(more, x -> x.share)) ELSE 0.0D END").alias("score"),
    )
