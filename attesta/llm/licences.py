"""Licence scan with a positional rare-token index, in DataFrame functions only.

Every licence template is a text with a mandatory key phrase. The index holds the words of key phrases with their
places. Of the licence words that a file has, those of the highest IDF over all documents are looked up: for each
template the two rarest words of its key phrase. A posting at place i proposes the template at i minus the word's
place in it; the proposals of the two words are intersected, which leaves the places where both stand at their
distance, and there the key phrase has to stand in full and most of the template's other words at their places.
No occurrence of a key phrase can be missed, because each contains its rare words. Nothing is shuffled but the
word counts of the key phrases' vocabulary.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read, slim

SHARE = 0.6  # of a template's words that must stand at their places, key phrase included

#: (label, base, key phrase, words before it, words after it)
TEMPLATES = [
    ("mit", True, "mit license", "", ""),
    ("apache", True, "apache license", "", ""),
    ("gpl", True, "general public license", "", ""),
    ("mit", False, "permission is hereby granted free of charge", "", "to any person obtaining a copy of this software"),
    ("mit", False, "the above copyright notice and this permission notice shall be included", "", "in all copies or substantial portions of the software"),
    ("apache", False, "except in compliance with the license", "you may not use this file", "you may obtain a copy of the license at"),
    ("lgpl", False, "lesser general public license", "gnu", ""),
    ("agpl", False, "affero general public license", "gnu", ""),
    ("gpl", False, "it under the terms of the gnu general public license", "you can redistribute it and or modify", "as published by the free software foundation"),
    ("bsd", False, "redistribution and use in source and binary forms", "", "with or without modification are permitted"),
    ("bsd", False, "bsd license", "", ""),
    ("mpl", False, "mozilla public license", "", ""),
    ("epl", False, "eclipse public license", "", ""),
    ("bsl", False, "boost software license", "", ""),
    ("isc", False, "permission to use copy modify and or distribute this software", "", "for any purpose with or without fee is hereby granted"),
    ("unlicense", False, "free and unencumbered software released into the public domain", "this is", ""),
    ("cc", False, "creative commons attribution", "", ""),
    ("cc-by-nc", False, "cc by nc", "", ""),
    ("cc-by-sa", False, "cc by sa", "", ""),
    ("cc-by-nd", False, "cc by nd", "", ""),
    ("cc-by", False, "cc by 4 0", "", ""),
    ("wtfpl", False, "do what the fuck you want to public license", "", ""),
    ("cc0", False, "cc0 1 0 universal", "", ""),
    ("reserved", False, "all rights reserved", "", ""),
    # whole texts
    ("mit", False, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "",
     "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
     "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
     "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
     "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software "
     "or the use or other dealings in the software"),
    ("isc", False, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "",
     "provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied "
     "warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
     "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd", False, "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "",
     "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of "
     "conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("apache", False, "licensed under the apache license version 2 0 the license", "",
     "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software "
     "distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and "
     "limitations under the license"),
    ("gpl", False, "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "",
     "as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without "
     "even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("mpl", False, "this source code form is subject to the terms of the mozilla public license v 2 0", "", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("zlib", False, "this software is provided as is without any express or implied warranty", "",
     "in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to "
     "alter it and redistribute it freely"),
    ("unlicense", False, "this is free and unencumbered software released into the public domain", "",
     "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
]

_SEPARATORS = "".join(chr(c) for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """Words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z; null has none."""
    folded = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    return F.filter(F.split(folded, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def _split(phrase: str) -> list[str]:
    return phrase.split()


def word_weights(tokens: DataFrame) -> dict[str, float]:
    """IDF over all documents of every key-phrase word: a row for each, whatever the corpus."""
    vocabulary = sorted({w for _, _, key, _, _ in TEMPLATES for w in _split(key)})
    held = tokens.select(F.explode(F.array_intersect("words", F.array(*map(F.lit, vocabulary)))).alias("w"))
    found = {r["w"]: r["n"] for r in held.groupBy("w").agg(F.count("*").alias("n")).collect()}
    most = max(found.values(), default=0)
    return {w: math.log((most + 1) / (found.get(w, 0) + 1)) for w in vocabulary}


def _rarest(key: list[str], weights: dict[str, float]) -> list[tuple[int, str]]:
    """Place and word of the two words of a key phrase with the highest IDF; of a word that repeats the first place."""
    places = sorted({w: i for i, w in reversed(list(enumerate(key)))}.items(), key=lambda x: (-weights[x[0]], x[1]))
    return [(i, w) for w, i in (places * 2)[:2]]


def _index(weights: dict[str, float]) -> list[Column]:
    """A struct for each template: its two index words with their places, key phrase and its place, all words, label, base."""
    out = []
    for label, base, key, before, after in TEMPLATES:
        k, b = _split(key), _split(before)
        (rare_at, rare), (second_at, second) = _rarest(k, weights)
        out.append(F.struct(
            F.lit(rare).alias("rare"), F.lit(len(b) + rare_at).alias("rare_at"), F.lit(second).alias("second"), F.lit(len(b) + second_at).alias("second_at"),
            F.array(*map(F.lit, k)).alias("key"), F.lit(len(b)).alias("key_at"), F.array(*map(F.lit, [*b, *k, *_split(after)])).alias("words"), F.lit(label).alias("label"), F.lit(base).alias("base"),
        ))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` but text, with n_words, places and score.

    places: label, base, start of the key phrase, and share of the template's words found, for every
    verified place in order. score: 1 where a base phrase stands, else the best share, else 0. A null
    or empty text has no words and no places. Rows are scanned one by one, so repeated rows and ids
    keep their own results; columns that are called n_words, places or score are replaced; an empty
    table gives an empty result.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_words", "places", "score")]).alias("row"), words(F.col("text")).alias("words"))
    weights = word_weights(rows)
    templates = F.array(*_index(weights))
    rare = F.array(*map(F.lit, sorted({_rarest(_split(key), weights)[0][1] for _, _, key, _, _ in TEMPLATES})))

    def starts(word: Column, at: Column) -> Column:
        """Where a template stands if this word's postings are at their place in it."""
        return F.filter(F.transform("words", lambda w, i: F.when(w == word, i - at)), lambda x: x.isNotNull())

    def proposed(t: Column) -> Column:
        met = F.array_intersect(starts(t["rare"], t["rare_at"]), starts(t["second"], t["second_at"]))
        return F.when(F.array_contains("words", t["rare"]) & F.array_contains("words", t["second"]), F.transform(met, lambda x: F.struct(x.alias("from"), t.alias("t"))))

    def verified(c: Column) -> Column:
        at = c["from"] + c["t"]["key_at"]
        return (at >= 0) & (F.slice("words", F.greatest(at, F.lit(0)) + 1, F.size(c["t"]["key"])) == c["t"]["key"])

    def place(c: Column) -> Column:
        there = F.filter(F.sequence(F.lit(0), F.size(c["t"]["words"]) - 1), lambda j: F.get(F.col("words"), c["from"] + j) == F.get(c["t"]["words"], j))
        return F.struct(
            (c["from"] + c["t"]["key_at"]).alias("start"), c["t"]["label"].alias("label"), c["t"]["base"].alias("base"),
            (F.size(there) / F.size(c["t"]["words"])).alias("share"),
        )

    met = rows.select("row", F.size("words").cast("long").alias("n_words"), "words")
    none = F.array().cast("array<struct<start:int,label:string,base:boolean,share:double>>")
    proposals = F.flatten(F.filter(F.transform(templates, proposed), lambda x: x.isNotNull()))
    places = F.when(~F.arrays_overlap("words", rare), none).otherwise(
        F.array_sort(F.filter(F.transform(F.filter(proposals, verified), place), lambda p: p["share"] >= SHARE))
    )
    return met.select("row", "n_words", places.alias("places")).select(
        "row.*", "n_words", "places",
        F.when(F.exists("places", lambda p: p["base"]), F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0))).alias("score"),
    )


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(slim(read(spark, sf_dir, "documents"), "doc_id", "text"))
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])
    joined = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("places")).alias("labels"), "score",
    )


def op3_license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the scan that SQL can state: places of the base phrases."""
    return op3_license_scans(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


OP3_BASE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, w, list_filter(range(1, len(w)), lambda i: w[i] = 'mit' AND w[i + 1] = 'license') AS m, list_filter(range(1, len(w)), lambda i: w[i] = 'apache' AND w[i + 1] = 'license') AS a,
             list_filter(range(1, len(w) - 1), lambda i: w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license') AS g FROM d),
q AS (SELECT *, list_concat(list_concat(m, a), g) AS every FROM p)
SELECT doc_id, len(w)::BIGINT AS n_words, len(every)::BIGINT AS n_base, list_min(every)::BIGINT - 1 AS first_word, list_max(every)::BIGINT - 1 AS last_word,
       concat_ws(',', CASE WHEN len(a) > 0 THEN 'apache' END, CASE WHEN len(g) > 0 THEN 'gpl' END, CASE WHEN len(m) > 0 THEN 'mit' END) AS base_labels FROM q
"""
