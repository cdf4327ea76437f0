"""License scans by a positional rare-token index. DataFrame functions only.

The index holds, for each word of the templates (license notices or whole licenses), its postings (template, position).
Words are ordered by inverse document frequency over all documents. For each file:

1. Anchors: the anchor of a mandatory key phrase is its rarest word. A template can only be reported if one of its phrases
   stands in the file, so the file's anchors lead to its candidates; a candidate needs all words of the phrase in the file.
2. Look-up: the file's rarest license words (LOOKED_UP of them) and its anchors are looked up. Each place of
   such a word, less a posting's position, is a relative position, and the postings of a template that meet at one relative position
   are an aligned copy. The share of the looked-up words of that template which align must reach ALIGNED_PERCENT.
3. Key phrases: one of the candidate's phrases must stand in the file, word by word.

In a whole copy every looked-up word of the template aligns, and its anchor is always among them, so no whole copy is lost, however
many rarer license words the file has. Work in a file follows its words and their postings, not the number of templates.
Everything after the frequencies happens inside the row, so no file's words are ever shuffled; the frequencies are
counted for the templates' words alone (a few rows for each word, whatever the corpus). The index is one constant of the
plan (JSON, parsed while planning), in buckets by the words' CRC32, so whole licenses make it no deeper.

Base: places where the words of a phrase stand consecutively (PHRASES).

Defined results: a null or empty text has no words, no labels and score 0; an empty table gives no
rows; repeated rows get the same labels each; words of equal frequency go by their letters; a very long text is one row of
words; only the id and text columns are read, so others may have any name.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartstone.llm.common import ascii_lower

#: Rarest license words of a file that are looked up.
LOOKED_UP = 16
#: Least share of the looked-up words that must align, in hundredths.
ALIGNED_PERCENT = 60
#: What stands between words, in lower-cased text.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Base phrases (fixed by contract): words, label.
PHRASES = (
    (("mit", "license"), "mit"),
    (("apache", "license"), "apache"),
    (("general", "public", "license"), "gpl"),
)

#: Notices of public licenses: label, text, mandatory key phrases (one must stand in the file).
TEMPLATES = (
    ("mit", "Released under the MIT License.", ("under the mit license",)),
    (
        "mit-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        ("permission is hereby granted free of charge",),
    ),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache license version 2 0",)),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
        ("you may not use this file except in compliance with the license",),
    ),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3.", ("gnu general public license version 3",)),
    (
        "gpl-header",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        ("under the terms of the gnu general public license",),
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
        ("mozilla public license v 2 0",),
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        ("distribute this software for any purpose with or without fee",),
    ),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("creative commons attribution 4 0",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
)


def split_words(text: str) -> list[str]:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return [w for w in re.split(SEPARATORS, lowered) if w]


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    phrases: tuple[str, ...]


def templates(items=TEMPLATES) -> list[Template]:
    return [Template(label, tuple(split_words(text)), tuple(phrases)) for label, text, phrases in items]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _vocabulary(index: list[Template]) -> list[str]:
    return sorted({w for t in index for w in (*t.words, *" ".join(t.phrases).split())})


def document_frequencies(df: DataFrame, text_col: str, vocabulary: list[str]) -> dict[str, int]:
    """In how many documents each template word stands; counted over all documents, a row for each word at most."""
    held = F.array_intersect(F.array(*map(F.lit, vocabulary)), words_of(F.col(text_col)))
    rows = df.select(F.explode(held).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    return {r.word: r.n for r in rows}


def anchors(index: list[Template], frequency: dict[str, int]) -> list[tuple[str, int, str]]:
    """(anchor, template, phrase) of each mandatory key phrase; the anchor is its rarest word."""
    rank = lambda w: (frequency.get(w, 0), w)
    return [(min(p.split(), key=rank), t, p) for t, template in enumerate(index) for p in template.phrases]


class _Table:
    """A constant map from words to arrays of structs, in buckets by the words' CRC32."""

    def __init__(self, rows: dict[str, list[dict]], kind: str):
        self.buckets = 1 << max(0, len(rows) // 4).bit_length()
        parts: list[dict] = [{} for _ in range(self.buckets)]
        for word, values in sorted(rows.items()):
            parts[zlib.crc32(word.encode()) % self.buckets][word] = values
        self.literal = F.from_json(F.lit(json.dumps(parts)), f"array<map<string,array<{kind}>>>")

    def of(self, word: Column) -> Column:
        return F.get(self.literal, F.pmod(F.crc32(word.cast("binary")), F.lit(self.buckets)).cast("int"))[word]


def postings(index: list[Template]) -> dict[str, list[dict]]:
    """Word to the templates and positions where it stands."""
    out: dict[str, list[dict]] = {}
    for t, template in enumerate(index):
        for p, w in enumerate(template.words):
            out.setdefault(w, []).append({"t": t, "p": p})
    return out


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, items=TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each document."""
    index = templates(items)
    vocabulary = _vocabulary(index)
    frequency = document_frequencies(df, text_col, vocabulary)
    rarest_first = sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w))
    out = df.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    words = F.col("words")

    def starts(phrase) -> Column:
        has = F.lit(True)
        for w in phrase:
            has = has & F.array_contains(words, w)
        there = lambda i: _all([F.get(words, i + k) == w for k, w in enumerate(phrase)])
        found = F.filter(F.sequence(F.lit(0), F.size(words) - len(phrase)), there)
        return F.when(has & (F.size(words) >= len(phrase)), found).otherwise(F.array().cast("array<int>"))

    out = out.withColumns({f"at{k}": starts(p) for k, (p, _) in enumerate(phrases)})
    # the file's license words, rarest first
    out = out.withColumn("present", F.array_intersect(F.array(*map(F.lit, rarest_first)), words))
    by_anchor: dict[str, list[dict]] = {}
    for word, t, phrase in anchors(index, frequency):
        by_anchor.setdefault(word, []).append({"t": t, "label": index[t].label, "phrase": f" {phrase} ", "keys": sorted(set(phrase.split()))})
    phrases_of = _Table(by_anchor, "struct<t:int,label:string,phrase:string,keys:array<string>>")
    postings_of = _Table(postings(index), "struct<t:int,p:int>")

    out = out.withColumn("anchors", F.array_intersect(F.col("present"), F.array(*map(F.lit, sorted(by_anchor)))))
    named = F.flatten(F.transform("anchors", phrases_of.of))
    out = out.withColumn("candidates", F.filter(named, lambda c: F.size(F.array_except(c["keys"], F.col("present"))) == 0))
    some = F.size("candidates") > 0
    none = F.array().cast("array<string>")
    out = out.withColumn("ids", F.array_distinct(F.transform("candidates", lambda c: c["t"])))
    looked = F.array_union(F.slice("present", 1, LOOKED_UP), F.col("anchors"))

    def entry(w: Column) -> Column:
        own = F.filter(F.coalesce(postings_of.of(w), F.array().cast("array<struct<t:int,p:int>>")), lambda x: F.array_contains(F.col("ids"), x["t"]))
        return F.struct(w.alias("w"), own.alias("at"))

    # looked-up words that stand in a candidate, with their postings there
    entries = F.filter(F.transform(F.when(some, looked).otherwise(none), entry), lambda e: F.size(e["at"]) > 0)
    out = out.withColumn("entries", entries)
    out = out.withColumn("looked", F.transform("entries", lambda e: e["w"]))
    places = F.transform(words, lambda w, i: F.struct(F.array_position(F.col("looked"), w).cast("int").alias("e"), i.alias("i")))
    hits = F.filter(places, lambda x: x["e"] > 0)
    out = out.withColumn("hits", F.when(F.size("looked") > 0, hits).otherwise(F.array().cast("array<struct<e:int,i:int>>")))
    votes = F.flatten(F.transform("hits", lambda h: F.transform(F.get("entries", h["e"] - 1)["at"], lambda x: F.struct(x["t"].alias("t"), (h["i"] - x["p"]).alias("d")))))
    out = out.withColumn("votes", F.sort_array(votes))
    out = out.withColumn("joined", F.when(some, F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))).otherwise(F.lit("")))
    aligned = F.transform(
        F.col("candidates"),
        lambda c: F.struct(
            c["label"].alias("label"),
            c["phrase"].alias("phrase"),
            F.size(F.filter("entries", lambda e: F.exists(e["at"], lambda x: x["t"] == c["t"]))).alias("n"),
            _longest_run(F.transform(F.filter("votes", lambda v: v["t"] == c["t"]), lambda v: v["d"])).alias("best"),
        ),
    )
    out = out.withColumn("aligned", aligned)
    accepted = F.filter(F.col("aligned"), lambda a: (a["best"] > 0) & (100 * a["best"] >= ALIGNED_PERCENT * a["n"]) & F.contains(F.col("joined"), a["phrase"]))
    out = out.withColumn("accepted", accepted)
    base = F.array_compact(F.array(*[F.when(F.size(f"at{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(phrases)]))
    out = out.withColumn("base", F.array_sort(F.array_distinct(base)))
    places = F.flatten(F.array(*[F.col(f"at{k}") for k in range(len(phrases))]))
    out = out.withColumn("places", places)
    share = F.transform(F.col("accepted"), lambda a: F.least(F.lit(1.0), a["best"] / a["n"]))
    labels = F.array_sort(F.array_union(F.col("base"), F.transform(F.col("accepted"), lambda a: a["label"])))
    return out.select(
        "doc_id",
        F.size(words).cast("long").alias("n_words"),
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(share), F.lit(0.0))).alias("score"),
    )


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _longest_run(sorted_values: Column) -> Column:
    """Most equal neighbours in a sorted array."""
    start = F.struct(F.lit(None).cast("int").alias("v"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a, x):
        run = F.when(a["v"].eqNullSafe(x), a["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("v"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

    return F.aggregate(sorted_values, start, step, lambda a: a["best"])


def oracle(source: str = "documents", items=TEMPLATES) -> str:
    """DuckDB SQL of the whole result: the same index as joins over word rows."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    index = templates(items)
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    starts = lambda p: f"words[i:i+{len(p) - 1}] = {list(p)!r}"
    label = " ".join(f"WHEN {starts(p)} THEN {quote(x)}" for p, x in PHRASES)
    at = ", ".join(f"({x['t']}, {x['p']}, {quote(w)})" for w, found in postings(index).items() for x in found)
    vocabulary = ", ".join(f"({quote(w)})" for w in _vocabulary(index))
    keys = ", ".join(f"({k}, {quote(t.label)}, {quote(f' {p} ')}, {sorted(set(p.split()))!r})" for k, t in enumerate(index) for p in t.phrases)
    return f"""
WITH w AS (SELECT doc_id, {words} AS words FROM {source}),
pl AS (SELECT doc_id, i, CASE {label} END AS label FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w WHERE list_contains(words, 'license')) WHERE {" OR ".join(starts(p) for p, _ in PHRASES)}),
g AS (SELECT doc_id, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, list_sort(list_distinct(list(label))) AS base FROM pl GROUP BY doc_id),
posting(t, pos, word) AS (VALUES {at}),
vocabulary(word) AS (VALUES {vocabulary}),
key(t, label, phrase, need) AS (VALUES {keys}),
tok AS (SELECT * FROM (SELECT doc_id, unnest(range(0, len(words))) AS i, unnest(words) AS word FROM w) WHERE word IN (SELECT word FROM vocabulary)),
held AS (SELECT DISTINCT doc_id, word FROM tok),
df AS (SELECT word, count(held.word) AS n FROM vocabulary LEFT JOIN held USING (word) GROUP BY 1),
anchor AS (SELECT DISTINCT arg_min(word, (n, word)) AS word FROM (SELECT t, phrase, unnest(need) AS word FROM key) JOIN df USING (word) GROUP BY t, phrase),
cand AS (SELECT doc_id, t, label, phrase, contains(' ' || array_to_string(words, ' ') || ' ', phrase) AS verified FROM w, key WHERE list_has_all(words, need)),
looked AS (SELECT doc_id, word FROM held JOIN df USING (word) LEFT JOIN (SELECT word, true AS is_anchor FROM anchor) USING (word)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n, word) <= {LOOKED_UP} OR is_anchor),
own AS (SELECT DISTINCT doc_id, t FROM cand),
size AS (SELECT doc_id, t, count(DISTINCT word) AS n FROM own JOIN looked USING (doc_id) JOIN posting USING (t, word) GROUP BY 1, 2),
hit AS (SELECT doc_id, t, tok.i - pos AS delta, count(*) AS c FROM own JOIN looked USING (doc_id) JOIN posting USING (t, word) JOIN tok USING (doc_id, word) GROUP BY 1, 2, 3),
best AS (SELECT doc_id, t, max(c) AS best FROM hit GROUP BY 1, 2),
ok AS (SELECT doc_id, list(label) AS labels, max(least(1.0::DOUBLE, best / n::DOUBLE)) AS share FROM cand JOIN best USING (doc_id, t) JOIN size USING (doc_id, t) WHERE verified AND 100 * best >= {ALIGNED_PERCENT} * n GROUP BY 1)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(array_to_string(base, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(base, labels))), ','), '') AS labels, CASE WHEN coalesce(n_base, 0) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM w LEFT JOIN g USING (doc_id) LEFT JOIN ok USING (doc_id)"""
