"""License scans with a positional index of rare words, as DataFrame expressions only.

Templates are word sequences with a label and a mandatory key phrase. Their words' inverse document frequencies are
counted over all texts; each template is posted, with position, under its ``KEYS`` rarest words. A text is looked up
only if it holds such a word. Each hit names a template and the place in the text where the template would begin;
hits that agree on the place are one alignment. An alignment's score is the share of the template's summed IDF
that stands at the same relative position; its key phrase must stand there whole. Base phrases are templates that are
all key phrase. Everything is within a row, so nothing is shuffled but a count per template word.

Words: A-Z lower-cased, then runs of ASCII digits, letters and non-ASCII characters. ``first_word`` and
``last_word`` are the smallest and largest start of a base phrase, words counted from 0.

Defined results: a null or empty text has no words, no places, empty label strings and score 0; a null doc_id is
kept; repeated rows each give a row; an empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.cluster import documents, text_of

#: Phrases and labels that results must carry.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Notices with label and key phrase, from the licences' own texts and the notices that they ask for.
NOTICES = (
    ("released under the mit license", "mit", "mit license"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit", "permission is hereby granted free of charge"),
    ("licensed under the apache license version 2 0", "apache-2", "apache license version 2"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", "apache-2", "without warranties or conditions of any kind"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3", "gnu general public license version 3"),
    ("this work is licensed under the gnu general public license version 2", "gpl-2", "gnu general public license version 2"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl", "terms of the gnu general public license"),
    ("this work is licensed under the gnu lesser general public license version 3", "lgpl-3", "gnu lesser general public license version 3"),
    ("you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1", "lgpl-2.1", "terms of the gnu lesser general public license"),
    ("this work is licensed under the gnu affero general public license version 3", "agpl-3", "gnu affero general public license version 3"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4", "cc by nc 4 0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4", "cc by sa 4 0"),
    ("licensed under cc by 4 0", "cc-by-4", "cc by 4 0"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4", "creative commons attribution 4 0"),
    ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "cc0", "waived all copyright and related or neighboring rights"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", "redistribution and use in source and binary forms"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2", "mozilla public license v 2 0"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "epl-2", "eclipse public license 2 0"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc", "for any purpose with or without fee is hereby granted"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "zlib", "in no event will the authors be held liable"),
    ("distributed under the boost software license version 1 0", "bsl-1", "boost software license version 1 0"),
    ("this is free and unencumbered software released into the public domain", "unlicense", "free and unencumbered software"),
)
KEYS = 3
LEAST_SCORE = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    words: tuple[str, ...]
    label: str
    key_from: int
    key_to: int
    base: bool


def templates() -> list[Template]:
    out = [Template(tuple(p.split()), label, 0, len(p.split()), True) for p, label in BASE]
    for text, label, key in NOTICES:
        words, own = text.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(own)] == own)
        out.append(Template(tuple(words), label, at, at + len(own), False))
    return out


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def idf(words: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """Inverse document frequency of each word of the vocabulary, which is fixed and small. words: a column ``words``."""
    held = words.select(F.explode(F.array_intersect("words", F.array(*map(F.lit, vocabulary)))).alias("word")).groupBy("word").count()
    counts = dict(held.unionByName(words.select(F.lit("").alias("word")).groupBy("word").count()).collect())
    return {w: log((1 + counts.get("", 0)) / (1 + counts.get(w, 0))) + 1e-9 for w in vocabulary}


def _lists(rows, kind: str) -> Column:
    return F.array(*(F.array(*(F.lit(x).cast(kind) for x in row)) for row in rows))


def license_scan(docs: DataFrame) -> DataFrame:
    """A row per document with its base places, labels and best score."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(text_of()).alias("words"))
    known = templates()
    rarity = idf(own, sorted({w for t in known for w in t.words}))
    posts: dict[str, list[tuple[int, int]]] = {}
    for k, t in enumerate(known):
        for word in sorted(set(t.words), key=lambda w: (-rarity[w], w))[:KEYS]:
            posts.setdefault(word, []).extend((k, i) for i, w in enumerate(t.words) if w == word)
    index = F.create_map(*(c for w, p in sorted(posts.items()) for c in (F.lit(w), F.array(*(F.struct(F.lit(k).alias("t"), F.lit(i).alias("p")) for k, i in p)))))
    keys = F.array(*map(F.lit, sorted(posts)))
    text_words, weights = _lists([t.words for t in known], "string"), _lists([[rarity[w] for w in t.words] for t in known], "double")
    totals = F.array(*(F.lit(sum(rarity[w] for w in t.words)) for t in known))
    key_from, key_to = (F.array(*(F.lit(v) for v in column)) for column in ([t.key_from for t in known], [t.key_to for t in known]))
    label, base = F.array(*(F.lit(t.label) for t in known)), F.array(*(F.lit(t.base) for t in known))

    words = F.col("words")
    hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: F.array_contains(keys, h["w"]))
    starts = F.flatten(F.transform(hits, lambda h: F.transform(F.element_at(index, h["w"]), lambda p: (h["i"] - p["p"]).cast("long") * len(known) + p["t"])))  # one number, so that distinct ones are found by hashing
    place_of = lambda x: F.struct(F.pmod(x, F.lit(len(known))).cast("int").alias("t"), F.floor(x / F.lit(len(known))).cast("int").alias("at"))
    place = lambda s, j: (F.get(words, s["at"] + j) == F.get(F.get(text_words, s["t"]), j)) & (s["at"] + j >= 0)
    every = lambda s: F.sequence(F.lit(0), F.size(F.get(text_words, s["t"])) - 1)
    stands = lambda s, j: F.coalesce(place(s, j), F.lit(False))

    def judged(s: Column) -> Column:
        got = F.aggregate(every(s), F.lit(0.0), lambda so_far, j: so_far + F.when(stands(s, j), F.get(F.get(weights, s["t"]), j)).otherwise(0.0))
        key = F.forall(F.sequence(F.get(key_from, s["t"]), F.get(key_to, s["t"]) - 1), lambda j: stands(s, j))
        return F.struct(s["t"].alias("t"), s["at"].alias("at"), F.least(F.lit(1.0), got / F.get(totals, s["t"])).alias("score"), key.alias("key"))

    nothing = F.array().cast("array<struct<t:int,at:int,score:double,key:boolean>>")
    found = F.when(F.arrays_overlap(words, keys), F.transform(F.transform(F.array_distinct(starts), place_of), judged)).otherwise(nothing)
    out = own.select("doc_id", F.size("words").cast("long").alias("n_words"), found.alias("found"))
    is_base = lambda f: F.get(base, f["t"])
    accepted = F.filter("found", lambda f: f["key"] & (f["score"] >= LEAST_SCORE))
    out = out.select("doc_id", "n_words", accepted.alias("all"))
    out = out.select("doc_id", "n_words", "all", F.filter("all", is_base).alias("base"))
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda f: F.get(label, f["t"])))), ",")
    at = F.transform("base", lambda f: f["at"].cast("long"))
    score = F.round(F.coalesce(F.array_max(F.transform("all", lambda f: f["score"])), F.lit(0.0)), 9)
    return out.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), names("base").alias("base_labels"), names("all").alias("labels"), score.alias("score")
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


QUERIES = {"op7_license_scan": op7_license_scan}
