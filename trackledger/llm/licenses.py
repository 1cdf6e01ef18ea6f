"""License scans with a positional index of rare tokens, in DataFrame functions alone.

Texts are words: runs of ASCII letters (lower-cased), digits and non-ASCII characters.
The index holds, for each template of ``TEMPLATES``, the places of all its words, and how rare
a word is by the texts of the whole corpus that have it.  Of a file's own words those of a
template that are rarest are looked up, ``RAREST`` of them: where one stands in the file and
in the template gives the place where the template would begin, and places on which several
words agree (``VOTES``) are verified: all mandatory phrases of the template must stand there.
A verified template gives its label, and the share of its words that are in place.

Base labels come from fixed phrases (``PHRASES``) anywhere in the text; labels are both.

A file's words are looked up where they are, so neither texts nor words are shuffled; only the
counts of the templates' words are, a row per word and task.  Files that lack a word of every
template's mandatory phrases are not looked at further, since nothing could be verified.
Null and empty texts have no words and no labels.  Rows are scored one by one; equal rows
have equal results, a null id is kept.  Extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The phrases whose places are counted, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Public licence notices (label, notice, mandatory phrases).
NOTICES = (
    ("mit", "Released under the MIT License", ("MIT License",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", ("Permission is hereby granted, free of charge",)),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all copies
        or substantial portions of the Software.""",
        ("Permission is hereby granted, free of charge", "shall be included in all copies or substantial portions"),
    ),
    ("apache", "Licensed under the Apache License, Version 2.0", ("Apache License, Version 2",)),
    (
        "apache",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
        ("Apache License, Version 2", "you may not use this file except in compliance with the License"),
    ),
    ("gpl", "Licensed under the GNU General Public License, version 3", ("GNU General Public License",)),
    (
        "gpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version.""",
        ("GNU General Public License as published by the Free Software Foundation",),
    ),
    ("lgpl", "Licensed under the GNU Lesser General Public License", ("Lesser General Public License",)),
    (
        "lgpl",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
        General Public License as published by the Free Software Foundation; either version 2.1 of the License, or
        (at your option) any later version.""",
        ("GNU Lesser General Public License as published by the Free Software Foundation",),
    ),
    ("mpl", "Subject to the terms of the Mozilla Public License, version 2.0", ("Mozilla Public License",)),
    (
        "mpl",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
        was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
        ("This Source Code Form is subject to the terms of the Mozilla Public License",),
    ),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", ("Redistribution and use in source and binary forms",)),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: 1. Redistributions of source code must retain the above copyright notice,
        this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
        above copyright notice, this list of conditions and the following disclaimer in the documentation and/or
        other materials provided with the distribution.""",
        ("Redistribution and use in source and binary forms", "Redistributions of source code must retain the above copyright notice"),
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
        ("Permission to use, copy, modify, and/or distribute",),
    ),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
        for any purpose, commercial or non-commercial, and by any means.""",
        ("free and unencumbered software",),
    ),
    ("cc-by", "Licensed under CC BY 4.0", ("CC BY 4",)),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ("CC BY-SA",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("CC BY-NC",)),
)


def _plain(text: str) -> str:
    return " ".join(re.findall("[a-z0-9]+", text.lower()))


#: The notices and phrases as words.
TEMPLATES = tuple((label, _plain(notice), tuple(_plain(p) for p in phrases)) for label, notice, phrases in NOTICES)
#: Words of a template that are looked up in a file, and how many have to agree on a place.
RAREST = 4
VOTES = 2
KELVIN, STAND_IN = "\u212a", "\u0138"  # the one character whose lower case would be an ASCII letter alone


def words_column(text: Column) -> Column:
    """The words of a text in order."""
    lowered = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(KELVIN), F.lit(STAND_IN)))
    return F.filter(F.split(lowered, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), lambda w: w != "")


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def document_counts(words: DataFrame) -> dict[str, int]:
    """For each word of the templates, how many rows have it (one entry per template word)."""
    vocabulary = sorted({w for _, notice, _ in TEMPLATES for w in notice.split()})
    found = words.select(F.explode(F.array_intersect("words", _strings(vocabulary))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counts = dict.fromkeys(vocabulary, 0)
    return counts | {r["word"]: r["n"] for r in found.collect()}


def template_index(counts: dict[str, int]) -> Column:
    """An array with a struct per template: its words, the rarest first with their places, and its mandatory phrases."""
    entries = []
    for label, notice, phrases in TEMPLATES:
        words = notice.split()
        places = {w: [k for k, x in enumerate(words) if x == w] for w in words}
        ranked = [F.struct(F.lit(w).alias("w"), F.array(*map(F.lit, places[w])).alias("places")) for w in sorted(places, key=lambda w: (counts[w], w))]
        known = []
        for phrase in phrases:
            phrase = phrase.split()
            start = next(k for k in range(len(words)) if words[k : k + len(phrase)] == phrase)
            known.append(F.struct(F.lit(start).alias("start"), _strings(phrase).alias("words")))
        needed = _strings(sorted({w for p in phrases for w in p.split()}))
        entries.append(F.struct(F.lit(label).alias("label"), _strings(words).alias("words"), F.array(*ranked).alias("ranked"), F.array(*known).alias("phrases"), needed.alias("needed")))
    return F.array(*entries)


def _positions(words: Column, word: Column) -> Column:
    return F.filter(F.transform(words, lambda x, i: F.when(x == word, i).otherwise(-1)), lambda i: i >= 0)


def verified(words: Column, template: Column) -> Column:
    """The shares of the template's words in place, at each place of the file where it is verified."""
    rarest = F.slice(F.filter(template["ranked"], lambda r: F.array_contains(words, r["w"])), 1, RAREST)

    def begins(r: Column) -> Column:
        at = _positions(words, r["w"])
        return F.flatten(F.transform(r["places"], lambda p: F.transform(at, lambda i: i - p)))

    def votes(at: Column) -> Column:
        return F.size(F.filter(rarest, lambda r: F.exists(r["places"], lambda p: F.coalesce(F.get(words, at + p) == r["w"], F.lit(False)))))

    def stands(at: Column) -> Column:
        return F.forall(template["phrases"], lambda p: F.when(at + p["start"] >= 0, F.slice(words, F.greatest(at + p["start"], F.lit(0)) + 1, F.size(p["words"])) == p["words"]).otherwise(False))

    def share(at: Column) -> Column:
        same = F.transform(template["words"], lambda w, k: F.coalesce(F.get(words, at + k) == w, F.lit(False)))
        return F.size(F.filter(same, lambda x: x)) / F.size(template["words"])

    places = F.array_distinct(F.flatten(F.transform(rarest, begins)))
    return F.transform(F.filter(places, lambda at: (votes(at) >= F.least(F.lit(VOTES), F.size(rarest))) & stands(at)), share)


def base_places(words: Column) -> list[Column]:
    """For each phrase, the words at which it starts."""

    def places(phrase: list[str]) -> Column:
        last = len(phrase) - 1

        def starts(w: Column, i: Column) -> Column:
            same = [F.get(words, i - (last - k)) == p for k, p in enumerate(phrase[:-1])]
            return F.when((w == phrase[-1]) & reduce(lambda a, b: a & b, same), i - last).otherwise(-1)

        return F.filter(F.transform(words, starts), lambda i: i >= 0)

    return [places(phrase.split()) for phrase, _ in PHRASES]


def scan(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each row."""
    words = docs.select(F.col(id_column).alias("id"), words_column(F.col(text)).alias("words"))
    counts = document_counts(words)
    index = template_index(counts)
    none = F.array().cast("array<int>")
    has = F.arrays_overlap("words", _strings(sorted({p.split()[-1] for p, _ in PHRASES})))
    places = [F.when(has, p).otherwise(none) for p in base_places(F.col("words"))]
    possible = F.filter(index, lambda t: F.forall(t["needed"], lambda w: F.array_contains("words", w)))
    found = F.transform(possible, lambda t: F.struct(t["label"].alias("label"), verified(F.col("words"), t).alias("shares")))
    found = F.filter(found, lambda x: F.size(x["shares"]) > 0)
    rarest = {min({w for p in phrases for w in p.split()}, key=lambda w: (counts[w], w)) for _, _, phrases in TEMPLATES}  # of each template's needed words
    first = F.arrays_overlap("words", _strings(sorted(rarest)))
    nothing = F.array().cast("array<struct<label:string,shares:array<double>>>")
    rows = words.select(
        "id", F.size("words").cast("long").alias("n_words"), *[p.alias(f"p{k}") for k, p in enumerate(places)], F.when(first, found).otherwise(nothing).alias("found")
    )
    all_places = F.concat(*[F.col(f"p{k}") for k in range(len(PHRASES))])
    base = F.filter(F.array(*[F.when(F.size(f"p{k}") > 0, label) for k, (_, label) in enumerate(PHRASES)]), lambda x: x.isNotNull())
    best = F.array_max(F.flatten(F.transform("found", lambda x: x["shares"])))
    score = F.greatest(F.coalesce(best, F.lit(0.0)), F.when(F.size(all_places) > 0, 0.5).otherwise(0.0))
    labels = F.concat(base, F.transform("found", lambda x: x["label"]))
    return rows.select(
        F.col("id").alias(id_column), "n_words", F.size(all_places).cast("long").alias("n_base"), F.array_min(all_places).cast("long").alias("first_word"),
        F.array_max(all_places).cast("long").alias("last_word"), F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("labels"), score.alias("score"),
    )
