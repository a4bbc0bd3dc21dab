"""License scan by a positional index of rare words.

Words are the runs of ASCII letters and digits and of all other than ASCII characters of the whole text, A-Z lower-cased. A
template is a notice with the phrases that it must have. Two kinds of labels come out: those of base phrases, by their
words standing consecutively, and those of templates.

Method. Document frequencies of all licence words come from all documents. Of each template whose phrases' words all occur, the
INDEXED occurring words of the highest inverse document frequency make the index: word -> templates and places in them. A file
looks up those of its words that are in the index; every occurrence votes for the place in the file at which a template would begin. Where
TOGETHER different words or more agree on it, the template may stand there, and does if all of its phrases stand
within DRIFT words of their place. Its share is the part of the indexed words' inverse frequency that agrees. Edits move
words against each other, so what a file has of a template may agree on several beginnings; the best counts.

score is the largest share of the templates found, and at least PHRASE where a base phrase stands.

Scale. All work is in Spark's own expressions. Texts are read twice, for frequencies (a row a licence word and
task) and for places; what is kept of a file are the places of indexed words and phrases. Votes are summed by (file, template,
beginning), and met with phrases by (file, template, stretch of DRIFT words), so that a file that repeats
a notice any number of times gives as many rows. What is broadcast are the templates: fixed, some hundred rows.

Edge cases: null and empty texts have no words and no labels; a repeated row is a file of its own, and so is a null doc_id;
of words equally frequent the first by code point are indexed; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: Words of a template that are indexed, how many must agree, and by how many words a phrase may be off.
INDEXED, TOGETHER, DRIFT = 4, 2, 16
#: Score of a file with a base phrase only.
PHRASE = 0.5

# Phrases and labels of the contract.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Public licence notices, with the phrases that must stand in them.
TEMPLATES = [
    ("mit", "Released under the MIT License", ["mit license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ["permission is hereby granted free of charge", "without restriction"]),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ["apache license version 2 0"]),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ["gnu general public license", "license version 3"]),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ["free software foundation", "gnu general public license"]),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ["gnu lesser general public license"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "conditions are met"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ["permission to use copy modify", "with or without fee"]),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["free and unencumbered software", "public domain"]),
    ("cc0-1.0", "dedicated all copyright and related rights to the public domain worldwide under CC0 1.0 Universal", ["public domain"]),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ["cc by 4 0"]),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0"]),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ["cc by sa 4 0"]),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ["cc by nc 4 0"]),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ["creative commons attribution noncommercial 4 0"]),
    ("copyright", "Copyright notice. No part of this publication may be reproduced or transmitted in any form without the prior written permission of the publisher", ["no part of this publication", "prior written permission"]),
]

#: A word of a lower-cased text, and what stands between words.
WORD, BETWEEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: str) -> list[str]:
    """The words of a template or phrase, which is ASCII."""
    return re.findall(r"[a-z0-9]+", text.lower())


def words(text: Column) -> Column:
    """The words of a text as an array; a null has none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    # lower() would change other letters too, some of them into ASCII
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    # splitting takes half the time of extracting; only the ends can be empty
    return F.array_remove(F.split(low, BETWEEN), "")


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _rows(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A few fixed rows as literals."""
    columns = [c.split() for c in schema.split(", ")]
    one = F.array(*[F.struct(*[F.lit(v).alias(n) for (n, _), v in zip(columns, row, strict=True)]) for row in rows])
    return spark.range(1).select(F.explode(one.cast(f"array<struct<{','.join(map(':'.join, columns))}>>")).alias("x")).select("x.*")


def _phrases(templates) -> list[str]:
    return sorted({*BASE, *(p for _, _, phrases in templates for p in phrases)})


def frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many rows of docs each word of a fixed vocabulary stands."""
    here = docs.select(words(F.col("text")).alias("words")).select(F.explode(F.array_intersect("words", _strings(vocabulary))).alias("word"))
    return dict.fromkeys(vocabulary, 0) | {r.word: r.n for r in here.groupBy("word").agg(F.count("*").alias("n")).collect()}


def index_of(templates, df: dict[str, int], n: int) -> list[tuple[str, int, int, int, int]]:
    """Postings (word, template, its place there, its number among the template's words, weight)."""
    out = []
    for t, (_, text, phrases) in enumerate(templates):
        if not all(df[w] for p in phrases for w in words_of(p)):
            continue
        places = words_of(text)
        for k, word in enumerate(sorted({w for w in places if df[w]}, key=lambda w: (df[w], w))[:INDEXED]):
            weight = math.floor(1000 * math.log((n + 1) / (df[word] + 1))) + 1
            out += [(word, t, i, k, weight) for i, w in enumerate(places) if w == word]
    return out


def places(words: Column, phrases: list[str]) -> Column:
    """(phrase, at) of every place where a phrase's words stand consecutively."""
    parts = [(p, words_of(p)) for p in phrases]
    firsts, seconds = sorted({w[0] for _, w in parts}), sorted({w[1] for _, w in parts})
    may = F.filter(F.transform(words, lambda w, i: F.when(w.isin(firsts) & F.get(words, i + 1).isin(seconds), i)), lambda i: i.isNotNull())
    here = lambda i: F.filter(F.array(*[F.when(F.slice(words, i + 1, len(w)) == _strings(w), F.struct(F.lit(p).alias("phrase"), i.alias("at"))) for p, w in parts]), lambda x: x.isNotNull())
    return F.flatten(F.transform(may, here))


def _hits(words: Column, index: list[str]) -> Column:
    """(word, at) of every indexed word."""
    return F.filter(F.transform(words, lambda w, i: F.when(w.isin(index), F.struct(w.alias("word"), i.alias("at")))), lambda x: x.isNotNull())


def files(docs: DataFrame, scratch: Scratch, templates=TEMPLATES) -> tuple[DataFrame, list[tuple[str, int, int, int, int]]]:
    """For each row of docs(doc_id, text) a number (file), n_words, places of phrases and of indexed words; and the index."""
    n = docs.count()
    df = frequencies(docs, sorted({w for _, text, _ in templates for w in words_of(text)}))
    index = index_of(templates, df, n)
    spread = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("words"))
    seen = spread.select("doc_id", F.size("words").cast("long").alias("n_words"), places(F.col("words"), _phrases(templates)).alias("places"), _hits(F.col("words"), sorted({w for w, *_ in index})).alias("hits"))
    enough = F.size(F.array_distinct("hits.word")) >= TOGETHER
    # numbers are drawn in the written table, so that they stay
    return scratch.keep(seen.withColumns({"hits": F.when(enough, F.col("hits")), "file": F.monotonically_increasing_id()}), "files"), index


def found(seen: DataFrame, index: list[tuple[str, int, int, int, int]], templates=TEMPLATES) -> DataFrame:
    """file, label, start (where the template would begin) and share of each template found in files seen."""
    spark = seen.sparkSession
    postings = _rows(spark, "word string, template int, place int, bit int, weight long", [(w, t, i, 1 << k, weight) for w, t, i, k, weight in index])
    whole = [sum(weight for _, u, _, _, weight in index if u == t) for t in range(len(templates))]
    facts = _rows(spark, "template int, label string, whole long, phrases int", [(t, label, whole[t], len(phrases)) for t, (label, _, phrases) in enumerate(templates)])
    must = _rows(spark, "phrase string, template int, place int, bit int", [(p, t, i, 1 << k) for t, (_, text, phrases) in enumerate(templates) for k, p in enumerate(phrases) for i in _at(words_of(text), words_of(p))])
    votes = seen.select("file", F.explode("hits").alias("x")).select("file", "x.*").join(F.broadcast(postings), "word")
    sums = votes.groupBy("file", "template", (F.col("at") - F.col("place")).alias("start")).agg(F.bit_or("bit").alias("bits"), F.sum("weight").alias("weight"))
    may = sums.where(F.bit_count("bits") >= TOGETHER).withColumn("stretch", F.explode(F.array(*[F.floor(F.col("start") / DRIFT) + d for d in (-1, 0, 1)])))
    stand = seen.select("file", F.explode("places").alias("x")).select("file", "x.*").join(F.broadcast(must), "phrase")
    stand = stand.select("file", "template", "bit", (F.col("at") - F.col("place")).alias("where")).withColumn("stretch", F.floor(F.col("where") / DRIFT))
    near = may.join(stand, ["file", "template", "stretch"]).where(F.abs(F.col("where") - F.col("start")) <= DRIFT)
    held = near.groupBy("file", "template", "start", "weight").agg(F.bit_or("bit").alias("held")).join(F.broadcast(facts), "template")
    return held.where(F.bit_count("held") == F.col("phrases")).select("file", "label", F.col("start").cast("long").alias("start"), (F.col("weight") / F.col("whole")).alias("share"))


def _at(text: list[str], phrase: list[str]) -> list[int]:
    at = [i for i in range(len(text)) if text[i : i + len(phrase)] == phrase]
    if not at:
        raise ValueError(f"a template lacks its phrase {' '.join(phrase)}")
    return at


def _labels(values: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(values)), ",")


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score for each row of docs(doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "licenses")
    seen, index = files(docs, scratch, templates)
    more = found(seen, index, templates).groupBy("file").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    base = F.filter("places", lambda p: p["phrase"].isin(list(BASE)))
    named = F.transform("base", lambda p: F.element_at(F.create_map(*[F.lit(x) for pair in BASE.items() for x in pair]), p["phrase"]))
    rows = seen.select("file", "doc_id", "n_words", base.alias("base")).join(more, "file", "left")
    at = F.transform("base", lambda p: p["at"].cast("long"))
    return rows.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        _labels(named).alias("base_labels"), _labels(F.concat(named, F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.size("base") > 0, F.lit(PHRASE)).otherwise(0.0)).alias("score"),
    )


def oracle(templates=TEMPLATES) -> str:
    """SQL that says the same as scan() of documents."""
    listed = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    rows = lambda name, columns, found: f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(str, r)) + ')' for r in found)})"
    every = list(enumerate(templates))
    return f"""
WITH {rows("tm", "template, place, w", [(t, i, f"'{w}'") for t, (_, text, _) in every for i, w in enumerate(words_of(text))])},
{rows("fact", "template, label, phrases", [(t, f"'{label}'", len(phrases)) for t, (label, _, phrases) in every])},
{rows("need", "template, w", [(t, f"'{w}'") for t, (_, _, phrases) in every for p in phrases for w in words_of(p)])},
{rows("must", "phrase, template, place", [(f"'{p}'", t, i) for t, (_, text, phrases) in every for p in phrases for i in _at(words_of(text), words_of(p))])},
{rows("ph", "phrase, w, p", [(f"'{p}'", f"'{words_of(p)[0]}'", listed(words_of(p))) for p in _phrases(templates)])},
{rows("base", "phrase, label", [(f"'{p}'", f"'{label}'") for p, label in BASE.items()])},
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{WORD}') AS t FROM documents),
tok AS (SELECT r, unnest(t) AS w, unnest(range(len(t))) AS pos FROM d),
df AS (SELECT w, count(DISTINCT r) AS n FROM tok WHERE w IN (SELECT w FROM tm) GROUP BY w),
live AS (SELECT template FROM need LEFT JOIN df USING (w) GROUP BY template HAVING count(*) = count(n)),
ranked AS (SELECT template, w, n, row_number() OVER (PARTITION BY template ORDER BY n, w) AS k FROM (SELECT DISTINCT template, w FROM tm) JOIN df USING (w) JOIN live USING (template)),
ix AS (SELECT template, w, floor(1000 * ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (n + 1)))::BIGINT + 1 AS weight FROM ranked WHERE k <= {INDEXED}),
post AS (SELECT * FROM tm JOIN ix USING (template, w)),
whole AS (SELECT template, sum(weight) AS whole FROM post GROUP BY template),
may AS (SELECT r, template, pos - place AS start, sum(weight) AS weight FROM tok JOIN post USING (w) GROUP BY ALL HAVING count(DISTINCT w) >= {TOGETHER}),
stand AS (SELECT r, phrase, pos FROM tok JOIN ph USING (w) JOIN d USING (r) WHERE list_slice(t, pos + 1, pos + len(p)) = p),
held AS (SELECT r, template, start, weight FROM may JOIN (SELECT r, phrase, template, pos - place AS off FROM stand JOIN must USING (phrase)) USING (r, template) JOIN fact USING (template)
    WHERE abs(off - start) <= {DRIFT} GROUP BY r, template, start, weight, phrases HAVING count(DISTINCT phrase) = phrases),
more AS (SELECT r, list(DISTINCT label) AS labels, max(weight::DOUBLE / whole) AS share FROM held JOIN fact USING (template) JOIN whole USING (template) GROUP BY r),
places AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels FROM stand JOIN base USING (phrase) GROUP BY r)
SELECT doc_id, len(t) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
    coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ','), '') AS labels,
    greatest(coalesce(share, 0.0), CASE WHEN n_base > 0 THEN {PHRASE} ELSE 0.0 END)::DOUBLE AS score
FROM d LEFT JOIN places b USING (r) LEFT JOIN more m USING (r)
"""
