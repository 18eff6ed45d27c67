"""Licence scan by a positional index of rare words, in DataFrame functions only.

Templates are indexed by word: where in which template it stands. Document frequencies of the template words come from
the whole corpus. Of each template's mandatory phrases the ``RARE`` words of highest IDF are looked up in every document;
each place of such a word proposes starts of its templates by relative position, and the proposals of a template's words
are intersected. A template that stands in a text has all of these words in their places, so none can be missed, whatever
else the text holds. A start counts when each mandatory phrase stands in its place and enough template words agree.
Licence phrases themselves are found wherever their words are consecutive.
"""

from __future__ import annotations

import dataclasses
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegauge.llm.common import words


#: Words of a template whose postings are intersected.
RARE = 3
#: A proposal is one number: the template above ``SHIFT`` bits, the start, which may be negative, above ``ZERO``.
SHIFT, ZERO = 33, 1 << 32


@dataclasses.dataclass(frozen=True)
class Template:
    label: str
    text: str
    mandatory: tuple[str, ...]


# Notices of public licences (words only, with mandatory phrases that stand in them).
TEMPLATES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("free software", "gnu general public license")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    Template("mit-notice", "released under the mit license", ("mit license",)),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "any person obtaining a copy")),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("agpl-3.0", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu affero general public license",)),
    Template("lgpl-notice", "under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    Template("apache-2.0-notice", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("except in compliance with the license", "as is basis")),
    Template("mit-warranty", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability", ("without warranty of any kind", "authors or copyright holders")),
    Template("bsd-warranty", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", ("copyright holders and contributors as is",)),
    Template("bsd-endorsement", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products derived from this software",)),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("authors be held liable",)),
    Template("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("any person or organization", "accompanying documentation")),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("cc0-1.0", "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    Template("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    Template("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", ("sil open font license",)),
    Template("wtfpl", "do what the fuck you want to public license", ("you want to public license",)),
    Template("cddl-1.0", "the contents of this file are subject to the terms of the common development and distribution license", ("common development and distribution license",)),
)
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def text_array(values) -> str:
    quoted = ", ".join("'" + re.sub(r"(['\\])", r"\\\1", value) + "'" for value in values)
    return f"array({quoted})" if quoted else "CAST(array() AS array<string>)"


def place_of(part: list[str], whole: list[str]) -> int:
    return next(i for i in range(len(whole) - len(part) + 1) if whole[i : i + len(part)] == part)


def inverse_frequencies(docs: DataFrame, vocabulary: list[str], text: str = "text") -> dict[str, float]:
    """IDF of every vocabulary word over all documents, in one scan; one number for each word reaches the driver."""
    # the empty text is no word: every document counts there once
    own = F.concat(F.array(F.lit("")), F.array_intersect(words(F.col(text)), F.expr(text_array(vocabulary))))
    seen = docs.select(F.explode(own).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    found = {row["word"]: row["n"] for row in seen}
    total = found.get("", 0)
    return {word: math.log((total + 1) / (found.get(word, 0) + 1)) for word in vocabulary}


def base_places(phrases: dict[str, str]) -> str:
    """SQL: (start, label) of every place of every phrase in ``w``."""
    parts = []
    for phrase, label in phrases.items():
        own = phrase.split()
        starts = f"filter(sequence(0, size(w) - {len(own)}), i -> w[i] = '{own[0]}' AND slice(w, i + 1, {len(own)}) = {text_array(own)})"
        parts.append(f"CASE WHEN size(w) >= {len(own)} THEN transform({starts}, i -> struct(i AS start, '{label}' AS label)) ELSE array() END")
    return f"concat({', '.join(parts)})"


def scan(docs: DataFrame, keys: list[str], text: str = "text", templates: tuple[Template, ...] = TEMPLATES, phrases: dict[str, str] | None = None, agreement: float = 0.6) -> DataFrame:
    """n_words, n_base, first_word, last_word, base_labels, found_labels, score of every document, beside the keys.

    ``agreement``: share of a template's words that must agree. NULL and empty texts: 0 words, no place (NULL), no
    label, score 0. The score is the best agreement of a verified template, and at least one half where a phrase
    stands. Repeated rows give a row each.
    """
    phrases = PHRASES if phrases is None else phrases
    bodies = [template.text.split() for template in templates]
    vocabulary = sorted({word for body in bodies for word in body})
    idf = inverse_frequencies(docs, vocabulary, text)
    # a verified template has its mandatory phrases, so all their words; a place of a phrase has its rarest too
    rarest = lambda phrase: max(phrase.split(), key=lambda word: (idf.get(word, 0.0), word))
    # postings by rank: the rarest words of all templates, their second rarest and so on; a template with fewer words repeats its last
    postings: list[dict[str, list[int]]] = [{} for _ in range(RARE)]
    for t, (template, body) in enumerate(zip(templates, bodies)):
        placed = {(place_of(p.split(), body) + i, word) for p in template.mandatory for i, word in enumerate(p.split())}
        order = sorted(placed, key=lambda x: (-idf[x[1]], x[1], x[0]))[:RARE]
        for rank in range(RARE):
            place, word = order[min(rank, len(order) - 1)]
            postings[rank].setdefault(word, []).append((t << SHIFT) + ZERO - place)
    signs = sorted(postings[0].keys() | {rarest(p) for p in phrases})
    bodies_sql = f"array({', '.join(text_array(body) for body in bodies)})"
    checks = []
    for template, body in zip(templates, bodies):
        placed = [(place_of(p.split(), body), p.split()) for p in template.mandatory]
        # texts may begin inside a template; a phrase itself must stand in the text whole, and slices start at 1 or later
        tests = [f"o.start >= {-at} AND slice(w, greatest(o.start + {at + 1}, 1), {len(own)}) = {text_array(own)}" for at, own in placed]
        checks.append(f"({' AND '.join(tests)})")
    verified = "CASE o.t " + " ".join(f"WHEN {i} THEN {check}" for i, check in enumerate(checks)) + " ELSE false END"
    labels = text_array([template.label for template in templates])

    frame = docs.select(*[F.col(f"`{key}`") for key in keys], words(F.col(text)).alias("w"))
    frame = frame.withColumn("_sign", F.expr(f"arrays_overlap(w, {text_array(signs)})"))
    frame = frame.withColumn("_base", F.when(F.col("_sign"), F.expr(base_places(phrases))))
    # every place of a looked-up word proposes its templates with the start they would have; ranks are intersected
    ranked = []
    for own_postings in postings:
        table = ", ".join(f"'{word}', array({', '.join(f'{entry}L' for entry in entries)})" for word, entries in sorted(own_postings.items()))
        places = f"filter(sequence(0, size(w) - 1), i -> array_contains({text_array(sorted(own_postings))}, w[i]))"
        ranked.append(f"flatten(transform({places}, i -> transform(element_at(map({table}), w[i]), q -> q + i)))")
    common = ranked[0]
    for other in ranked[1:]:
        common = f"array_intersect({common}, {other})"
    offers = f"transform({common}, o -> struct(CAST(shiftright(o, {SHIFT}) AS INT) AS t, CAST((o & {(1 << SHIFT) - 1}L) - {ZERO}L AS INT) AS start))"
    wanted = F.col("_sign") & F.expr(f"arrays_overlap(w, {text_array(sorted(postings[0]))})")
    frame = frame.withColumn("_offers", F.when(wanted, F.expr(offers)))
    # template words beyond either end of the text do not agree
    agrees = f"size(filter(sequence(0, size({bodies_sql}[o.t]) - 1), j -> get(w, o.start + j) = {bodies_sql}[o.t][j])) / size({bodies_sql}[o.t])"
    checked = f"transform(filter(_offers, o -> {verified}), o -> struct({labels}[o.t] AS label, {agrees} AS share))"
    frame = frame.withColumn("_found", F.when(F.col("_sign"), F.expr(f"filter({checked}, x -> x.share >= {agreement})")))
    base = F.col("_base")
    starts = F.transform(base, lambda x: x["start"])
    own = F.coalesce(F.array_sort(F.array_distinct(F.transform(base, lambda x: x["label"]))), F.expr("CAST(array() AS array<string>)"))
    other = F.coalesce(F.array_sort(F.array_distinct(F.transform("_found", lambda x: x["label"]))), F.expr("CAST(array() AS array<string>)"))
    best = F.coalesce(F.array_max(F.transform("_found", lambda x: x["share"])), F.lit(0.0))
    return frame.select(
        *[F.col(f"`{key}`") for key in keys], F.size("w").cast("bigint").alias("n_words"),
        F.when(base.isNull(), 0).otherwise(F.size(base)).cast("bigint").alias("n_base"),
        F.array_min(starts).cast("bigint").alias("first_word"), F.array_max(starts).cast("bigint").alias("last_word"),
        own.alias("base_labels"), other.alias("found_labels"),
        F.greatest(best, F.when(F.size(own) > 0, 0.5).otherwise(0.0)).cast("double").alias("score"),
    )


def scan_sql(words_sql: str, templates: tuple[Template, ...] = TEMPLATES, phrases: dict[str, str] | None = None, agreement: float = 0.6) -> str:
    """DuckDB SQL of ``scan`` over ``documents`` with joined labels: every place of each template's first mandatory
    phrase is compared, without an index. ``words_sql`` is the word list of a document."""
    text_list = lambda values: "[" + ", ".join(f"'{value}'" for value in values) + "]"
    rows, firsts = [], set()
    for template in templates:
        body, own = template.text.split(), [p.split() for p in template.mandatory]
        firsts.add(own[0][0])
        rows.append(f"('{template.label}', {text_list(body)}, {[place_of(p, body) for p in own]}, [{', '.join(map(text_list, own))}])")
    known = [(label, phrase.split()) for phrase, label in (PHRASES if phrases is None else phrases).items()]
    firsts |= {own[0] for _, own in known}
    return f"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, {words_sql} AS w FROM documents),
p AS (SELECT id, w, unnest(list_filter(range(len(w)), lambda i: list_contains({text_list(sorted(firsts))}, w[i + 1]))) AS s FROM d),
k(label, own) AS (VALUES {", ".join(f"('{label}', {text_list(own)})" for label, own in known)}),
b AS (SELECT id, count(*) AS n, min(s) AS first, max(s) AS last, list_distinct(list(label)) AS labels FROM p JOIN k ON p.w[s + 1] = own[1] AND p.w[s + 1 : s + len(own)] = own GROUP BY id),
t(label, body, places, own) AS (VALUES {", ".join(rows)}),
o AS (SELECT id, w, label, body, places, own, s - places[1] AS start FROM p JOIN t ON p.w[s + 1] = own[1][1]),
v AS (SELECT id, label, len(list_filter(range(len(body)), lambda j: start + j >= 0 AND w[start + j + 1] = body[j + 1])) / len(body) AS share FROM o
WHERE len(list_filter(range(len(own)), lambda j: start + places[j + 1] >= 0 AND w[start + places[j + 1] + 1 : start + places[j + 1] + len(own[j + 1])] = own[j + 1])) = len(own)),
f AS (SELECT id, max(share) AS best, list_distinct(list(label)) AS labels FROM v WHERE share >= {agreement} GROUP BY id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(b.n, 0) AS n_base, b.first AS first_word, b.last AS last_word,
array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ',') AS labels,
greatest(coalesce(f.best, 0.0), CASE WHEN b.n > 0 THEN 0.5 ELSE 0.0 END)::DOUBLE AS score FROM d LEFT JOIN b USING (id) LEFT JOIN f USING (id)"""


def joined(labels: Column) -> Column:
    return F.array_join(labels, ",")
