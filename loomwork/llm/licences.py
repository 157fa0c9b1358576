"""Licence scans by a positional index of rare words, in DataFrame functions alone.

A template is the text of a licence or of a grant, with key phrases that must stand in it. Document frequencies of all words of
all templates are counted over the whole corpus; the index holds, for each template, its words of highest inverse
document frequency (of those that occur at all) with all their positions. A file looks up its words in the index: each
posting of a template position votes for the place in the file where the template would begin. Postings of one template
that vote for one place agree in their relative positions; where enough do, the key phrases are looked for in the file, near
where the template has them.

Phrases that count wherever they stand are found likewise: their rarest word is looked up, and the others must stand around
it in the file.

The index is bounded by the templates. Votes are numbers in an array of the row, sorted, so that equal ones stand together;
rows stay where they are and nothing but the counts of template words is shuffled.

Defined results: a null text is an empty one, without words or labels. Repeated rows count as often as they occur in the
frequencies and get equal results. Words of equal frequency are taken in alphabetical order. An empty table gives an empty
table. Columns named like an output are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OWN, drop_clashing, spread, table
from .urls import LOWER, UPPER

#: A word, after A-Z are lower-cased: ASCII letters and digits and all beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rarest words of a template that the index holds, postings of them that must agree on a place (all, if there are fewer),
#: and how many words a key phrase may stand away from its place.
RARE, AGREE, SLACK = 8, 3, 30
#: What a phrase alone says about the licence of a file.
PHRASE_SCORE = 0.5
#: A vote is a template's number times this, and the place; places may be negative by less than the second.
SHIFT, BIAS = 1 << 40, 1 << 20


def split_words(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]  # phrases of the text that a file must hold
    words: list[str] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "words", split_words(self.text))
        for k in self.keys:
            self.place(k)

    def place(self, phrase: str) -> int:
        """Where a key phrase first stands in the template."""
        key = split_words(phrase)
        for i in range(len(self.words) - len(key) + 1):
            if self.words[i : i + len(key)] == key:
                return i
        raise ValueError(f"the template of {self.label} doesn't hold {phrase!r}")


#: Phrases that count wherever they stand, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: The wording of well-known notices and grants.
TEMPLATES = [
    Template("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("permission is hereby granted free of charge", "deal in the software without restriction")),
    Template("isc-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ("for any purpose with or without fee is hereby granted",)),
    Template("bsd-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", ("redistribution and use in source and binary forms", "must retain the above copyright notice")),
    Template("zlib-text", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications", ("in no event will the authors be held liable", "permission is granted to anyone to use this software for any purpose")),
    Template("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", ("free and unencumbered software released into the public domain",)),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, you can obtain one at", ("subject to the terms of the mozilla public license",)),
    Template("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("redistribute it and or modify it under the terms of the gnu", "general public license as published by the free software foundation")),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    Template("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    Template("agpl", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("gnu affero general public license",)),
    Template("mit-grant", "Released under the MIT License", ("under the mit license",)),
    Template("cc-by", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    Template("cc-by-text", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution",)),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal public domain dedication", ("waived all copyright and related or neighboring rights",)),
]


def words_of(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(lower, F.lit(f"({WORD})"), 1)


def frequencies(files: DataFrame, words: Iterable[str], text: str = "text") -> dict[str, int]:
    """In how many files each of ``words`` occurs; those in none are left out. A row for each of the words, which are those
    of the templates, is all that reaches the driver."""
    held = F.filter(F.array_distinct(words_of(F.col(text))), lambda w: w.isin(sorted(words)))
    rows = files.select(F.explode(held).alias("word")).groupBy("word").count()
    return {r["word"]: r["count"] for r in rows.collect()}


@dataclass
class Index:
    templates: list[Template]
    phrases: dict[str, str]
    postings: dict[str, list[int]]  # word: votes of the template positions, for a word at place 0
    sizes: list[int]  # postings of each template
    anchors: dict[str, int]  # phrase: which of its words is looked up

    @property
    def words(self) -> list[str]:
        return sorted(self.postings)


def build(files: DataFrame, templates: list[Template] | None = None, phrases: dict[str, str] | None = None, text: str = "text") -> Index:
    """The index of ``templates`` and ``phrases`` for the corpus ``files``."""
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    vocabulary = {w for t in templates for w in t.words} | {w for p in phrases for w in split_words(p)}
    seen = frequencies(files, vocabulary, text)
    rank = lambda w: (seen[w], w)
    postings: dict[str, list[int]] = {}
    sizes = []
    for t, template in enumerate(templates):
        # a template with a key phrase of words that the corpus lacks can stand nowhere in it
        possible = all(w in seen for k in template.keys for w in split_words(k))
        rare = sorted({w for w in template.words if w in seen}, key=rank)[:RARE] if possible else []
        spots = [(w, q) for q, w in enumerate(template.words) if w in rare]
        for w, q in spots:
            postings.setdefault(w, []).append(t * SHIFT + BIAS - q)
        sizes.append(len(spots))
    anchors = {p: min(range(len(split_words(p))), key=lambda k: (seen.get(split_words(p)[k], 0), split_words(p)[k])) for p in phrases}
    return Index(templates, phrases, postings, sizes, anchors)


def _phrase_places(words: Column, phrase: str, at: int) -> Column:
    """Where a phrase begins, wherever its words stand consecutively; looked up by its word number ``at``."""
    key = split_words(phrase)
    spots = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i) == key[at])
    around = lambda i: (i >= at) & (F.slice(words, F.greatest(i - at, F.lit(0)) + 1, len(key)) == F.array(*map(F.lit, key)))
    found = F.transform(F.filter(spots, around), lambda i: (i - at).cast("long"))
    return F.when(F.array_contains(words, key[at]), found).otherwise(F.array().cast("array<bigint>"))


def _matches(words: Column, index: Index, votes: Column) -> Column:
    """Templates that begin at a place on which enough sorted votes agree and whose key phrases stand near it."""
    keys = [[(k, t.place(k), len(split_words(k))) for k in t.keys] for t in index.templates]
    rule = lambda k, q, n: F.struct(F.lit(" " + " ".join(split_words(k)) + " ").alias("key"), F.lit(q).alias("at"), F.lit(n).alias("n"))
    rules = F.array(*[F.array(*[rule(*k) for k in ks]) for ks in keys])
    need = F.array(*[F.lit(max(1, min(AGREE, n))) for n in index.sizes])
    sizes = F.array(*[F.lit(max(1, n)) for n in index.sizes])
    labels = F.array(*[F.lit(t.label) for t in index.templates])
    number = lambda v: F.call_function("shiftright", v, F.lit(SHIFT.bit_length() - 1)).cast("int")
    place = lambda v: (v.bitwiseAND(SHIFT - 1) - BIAS).cast("int")

    def agreed(v: Column, j: Column) -> Column:
        first = (j == 0) | (F.get(votes, j - 1) != v)
        return first & F.coalesce(F.get(votes, j + F.get(need, number(v)) - 1) == v, F.lit(False))

    def support(v: Column) -> Column:
        at = F.array_position(votes, v).cast("int")
        more = F.filter(F.sequence(F.lit(0), F.lit(max(index.sizes, default=1) - 1)), lambda s: F.coalesce(F.get(votes, at - 1 + s) == v, F.lit(False)))
        return F.size(more) / F.get(sizes, number(v))

    def verified(v: Column) -> Column:
        def near(r: Column) -> Column:
            start = F.greatest(place(v) + r["at"] - SLACK, F.lit(0))
            length = F.greatest(place(v) + r["at"] + r["n"] + SLACK - start, F.lit(0))
            return F.concat(F.lit(" "), F.array_join(F.slice(words, start + 1, length), " "), F.lit(" ")).contains(r["key"])

        return F.forall(F.get(rules, number(v)), near)

    found = F.filter(F.filter(votes, agreed), verified)
    return F.transform(found, lambda v: F.struct(F.get(labels, number(v)).alias("label"), place(v).alias("place"), support(v).alias("share")))


def scan(files: DataFrame, index: Index, text: str = "text") -> DataFrame:
    """``files`` with ``n_words``, ``phrases`` (label and place of each phrase), ``licences`` (label, place and share of
    agreeing postings of each template found), ``labels`` (distinct, sorted) and ``score``."""
    made = ["n_words", "phrases", "licences", "labels", "score"]
    files = drop_clashing(files, [c for c in made if c != text])
    kept = [c for c in files.columns if c.lower() not in made]
    words, votes = F.col(f"{OWN}words"), F.col(f"{OWN}votes")
    files = files.withColumn(f"{OWN}words", words_of(F.col(text)))
    none = F.array().cast("array<bigint>")
    votes_name = f"{OWN}votes"
    if index.postings:
        known = F.map_from_arrays(F.array(*map(F.lit, index.words)), F.array(*[F.array(*[F.lit(v).cast("long") for v in index.postings[w]]) for w in index.words]))
        hits = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(index.words))
        cast = F.transform(hits, lambda i: F.transform(F.try_element_at(known, F.get(words, i)), lambda v: v + i))
        held = F.arrays_overlap(words, F.array(*map(F.lit, index.words)))
        files = files.withColumn(votes_name, F.when(held, F.sort_array(F.flatten(cast))).otherwise(none))
    else:
        files = files.withColumn(votes_name, none)
    spot = lambda label: lambda i: F.struct(F.lit(label).alias("label"), i.alias("place"))
    places = [F.transform(_phrase_places(words, p, index.anchors[p]), spot(label)) for p, label in index.phrases.items()]
    files = files.withColumn(f"{OWN}phrases", F.concat(*places) if places else F.array().cast("array<struct<label:string,place:bigint>>"))
    licences = _matches(words, index, votes) if index.templates else F.array().cast("array<struct<label:string,place:int,share:double>>")
    files = files.withColumn(f"{OWN}licences", licences)
    phrases, found = F.col(f"{OWN}phrases"), F.col(f"{OWN}licences")
    labels = F.array_sort(F.array_distinct(F.concat(F.transform(phrases, lambda p: p["label"]), F.transform(found, lambda m: m["label"]))))
    best = F.coalesce(F.array_max(F.transform(found, lambda m: m["share"])), F.lit(0.0))
    score = F.greatest(best, F.when(F.size(phrases) > 0, PHRASE_SCORE).otherwise(0.0))
    return files.select(*kept, F.size(words).cast("long").alias("n_words"), phrases.alias("phrases"), found.alias("licences"), labels.alias("labels"), score.alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    files = spread(table(spark, sf_dir, "documents")).select("doc_id", "text")
    seen = scan(files, build(files))
    places = F.transform("phrases", lambda p: p["place"])
    base = F.array_sort(F.array_distinct(F.transform("phrases", lambda p: p["label"])))
    return seen.select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


def oracle_sql(templates: list[Template] | None = None) -> str:
    """The same rules by joins of all words: frequencies, rarest words, votes, key phrases."""
    templates = TEMPLATES if templates is None else templates
    quoted = lambda s: "'" + s + "'"
    words = ", ".join(f"({t}, {q}, {quoted(w)})" for t, x in enumerate(templates) for q, w in enumerate(x.words))
    labels = ", ".join(f"({t}, {quoted(x.label)})" for t, x in enumerate(templates))
    keys = ", ".join(f"({t}, {x.place(k)}, {quoted(' '.join(split_words(k)))}, {len(split_words(k))})" for t, x in enumerate(templates) for k in x.keys)
    phrases = ", ".join(f"({quoted(p)}, {len(p.split())}, {quoted(label)})" for p, label in PHRASES.items())
    return rf"""
WITH files AS (
  SELECT row_number() OVER () AS file, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM documents
), spots AS (
  SELECT file, unnest(words) AS word, unnest(range(len(words))) AS i FROM files
), template_words(t, q, word) AS (VALUES {words}
), labels_of(t, label) AS (VALUES {labels}
), keys(t, q, phrase, n) AS (VALUES {keys}
), phrases(phrase, n, label) AS (VALUES {phrases}
), seen AS (
  SELECT word, count(DISTINCT file) AS df FROM spots WHERE word IN (SELECT word FROM template_words) GROUP BY word
), rare AS (
  SELECT t, word FROM (
    SELECT t, word, row_number() OVER (PARTITION BY t ORDER BY df, word) AS r FROM (SELECT DISTINCT t, word FROM template_words) JOIN seen USING (word)
  ) WHERE r <= {RARE}
), postings AS (
  SELECT t, q, word FROM template_words JOIN rare USING (t, word)
), sizes AS (
  SELECT t, count(*) AS size FROM postings GROUP BY t
), votes AS (
  SELECT file, t, i - q AS place, count(*) AS votes FROM spots JOIN postings USING (word) GROUP BY ALL
), agreed AS (
  SELECT file, t, place, votes / size AS share FROM votes JOIN sizes USING (t) WHERE votes >= least({AGREE}, size)
), lacking AS (
  SELECT DISTINCT file, t, place FROM agreed JOIN files USING (file) JOIN keys USING (t)
  WHERE NOT contains(' ' || array_to_string(words[greatest(place + q - {SLACK}, 0) + 1:greatest(place + q + n + {SLACK}, 0)], ' ') || ' ', ' ' || phrase || ' ')
), found AS (
  SELECT file, label, share FROM agreed ANTI JOIN lacking USING (file, t, place) JOIN labels_of USING (t)
), base AS (
  SELECT file, i, label FROM spots JOIN files USING (file) JOIN phrases ON word = split_part(phrase, ' ', 1) AND array_to_string(words[i + 1:i + n], ' ') = phrase
), based AS (
  SELECT file, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY file
), named AS (
  SELECT file, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT file, label FROM base UNION SELECT file, label FROM found) GROUP BY file
), best AS (
  SELECT file, max(share) AS share FROM found GROUP BY file
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, greatest(coalesce(share, 0.0), CASE WHEN n_base > 0 THEN {PHRASE_SCORE} ELSE 0.0 END) AS score
FROM files LEFT JOIN based USING (file) LEFT JOIN named USING (file) LEFT JOIN best USING (file)
"""
