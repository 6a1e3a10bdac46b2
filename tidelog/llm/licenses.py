"""Operator 2: licence scans by a positional rare-token index, in DataFrame functions only.

Every template is the words of a licence clause, with a mandatory key phrase. Documents that have all
words of some key phrase are kept with their words; all documents count for the frequencies of the
key words. The index has, under each key word, its places in the templates. In a file, each template
is looked up under its two highest-IDF key words; the places that both give, by relative position, are
candidates, and the key phrase must stand there word for word.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import ascii_lower, table, written

GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """text: words as they are cut, in lower case; key: words that stand together in it. One word is enough for either."""

    label: str
    text: str
    key: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_words(self) -> list[str]:
        return self.key.split()

    @property
    def key_at(self) -> int:
        w, k = self.words, self.key_words
        return next(i for i in range(len(w)) if w[i : i + len(k)] == k)


#: The base phrases, then clauses and notices of licences in common use.
TEMPLATES = (
    Template("mit", "under the mit license", "under the mit license", True),
    Template("apache-2", "apache license version 2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", "cc by nc", True),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "permission is hereby granted free of charge",
    ),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "you may not use this file except in compliance with the license"),
    Template("gpl", "this work is licensed under the gnu general public license", "gnu general public license"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    Template("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistribution and use in source and binary forms",
    ),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    Template("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse public license"),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "permission to use copy modify and or distribute",
    ),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
    Template("bsl", "boost software license version 1 0", "boost software license"),
    Template("cc-by", "this work is licensed under a creative commons attribution international license", "creative commons attribution"),
    Template("cc0", "dedicated to the public domain under cc0", "public domain under cc0"),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose",
        "free and unencumbered software",
    ),
    Template("proprietary", "all rights reserved", "all rights reserved"),
)


def words_of(docs: DataFrame) -> DataFrame:
    """doc_id and words. Lower case by the built-in but for texts with a letter whose lower case is or begins with an ASCII one."""
    text = F.coalesce("text", F.lit(""))
    low = F.when(F.contains(text, F.lit("\u212a")) | F.contains(text, F.lit("\u0130")), ascii_lower(text)).otherwise(F.lower(text))
    return docs.select("doc_id", F.array_remove(F.split(low, GAPS), "").alias("words"))


def candidates(words: DataFrame, templates: tuple[Template, ...]) -> DataFrame:
    """doc_id, n_words, has (the key words that stand in it), words (of documents that have all words of some key phrase; else empty), written once."""
    vocabulary = sorted({w for t in templates for w in t.key_words})
    seen = words.select("doc_id", "words", F.array_intersect("words", F.lit(vocabulary)).alias("has"))
    keys = F.lit([sorted(set(t.key_words)) for t in templates])
    some = F.exists(keys, lambda key: F.size(F.array_except(key, "has")) == 0)
    kept = F.when((F.size("has") > 0) & some, F.col("words")).otherwise(F.array().cast("array<string>"))
    return written(seen.select("doc_id", F.size("words").cast("long").alias("n_words"), "has", kept.alias("words")), "licence-words")


def frequencies(found: DataFrame) -> dict[str, int]:
    """In how many documents each key word stands. One number for each of these words goes to the driver."""
    return {r["word"]: r["n"] for r in found.select(F.explode("has").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}


def rare_places(template: Template, df: dict[str, int]) -> list[tuple[str, int]]:
    """The key phrase's two words of highest IDF with their places in the template: fewest documents first, then by word and place; of one word, that one twice."""
    places = sorted(((w, template.key_at + k) for k, w in enumerate(template.key_words)), key=lambda x: (df.get(x[0], 0), x[0], x[1]))
    return [places[0], places[min(1, len(places) - 1)]]


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, matches: array of (template, label, base, start, verified, score) for each row of docs.

    A match is a place where a template's key phrase stands word for word (verified, always true); start is where the template
    begins, which may lie before the text, and score the part of the template's words that stand in
    place. Null or empty text has no word; null doc_id and repeated rows stay; an empty table gives no
    row; other columns are ignored."""
    found = candidates(words_of(docs), templates)
    df = frequencies(found)
    places = [rare_places(t, df) for t in templates]
    texts, keys = F.lit([t.words for t in templates]), F.lit([t.key_words for t in templates])

    def looked_up(which: int) -> Column:
        """(template, start) of every place of a key word that is some template's rarest (which = 0) or second rarest (1)."""
        postings: dict[str, list[Column]] = {}
        for k, two in enumerate(places):
            postings.setdefault(two[which][0], []).append(F.struct(F.lit(k).alias("template"), F.lit(two[which][1]).alias("at")))
        index = F.map_from_entries(F.array(*(F.struct(F.lit(w), F.array(*p)) for w, p in sorted(postings.items()))))
        spots = F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(sorted(postings)), F.struct(w.alias("word"), i.alias("i")))))
        hits = F.transform(spots, lambda s: F.transform(F.element_at(index, s["word"]), lambda p: F.struct(p["template"].alias("template"), (s["i"] - p["at"]).alias("start"))))
        return F.flatten(hits)

    def verified(h: Column) -> Column:
        key = F.get(keys, h["template"])
        at = h["start"] + F.get(F.lit([t.key_at for t in templates]), h["template"])
        return (at >= 0) & (F.slice("words", F.greatest(at, F.lit(0)) + 1, F.size(key)) == key)

    def match(h: Column) -> Column:
        text = F.get(texts, h["template"])
        equal = F.size(F.filter(F.transform(text, lambda w, j: F.get("words", h["start"] + j) == w), lambda same: same))
        label, base = F.get(F.lit([t.label for t in templates]), h["template"]), F.get(F.lit([t.base for t in templates]), h["template"])
        return F.struct(h["template"].alias("template"), label.alias("label"), base.alias("base"), h["start"].cast("long").alias("start"), F.lit(True).alias("verified"), (equal.cast("double") / F.size(text)).alias("score"))

    none = F.array().cast("array<struct<template:int,label:string,base:boolean,start:bigint,verified:boolean,score:double>>")
    hits = F.filter(F.array_intersect(looked_up(0), looked_up(1)), verified)
    return found.select("doc_id", "n_words", F.when(F.size("words") > 0, F.transform(hits, match)).otherwise(none).alias("matches"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m["base"])
    labels = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    starts = F.transform(base, lambda m: m["start"])
    score = F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0))
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels("matches").alias("labels"), score.alias("score"))


def oracle() -> str:
    """The same in DuckDB SQL: every place of a key phrase's first word, the phrase, and the template's words around it."""
    rows = ", ".join(f"({k}, '{t.label}', {str(t.base).lower()}, {t.key_words!r}, {t.words!r}, {t.key_at})" for k, t in enumerate(TEMPLATES))
    return f"""
WITH tp(t, label, base, key, words, key_at) AS (VALUES {rows}),
ws AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
pos AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS i FROM ws),
m AS (SELECT p.r, tp.label, tp.base, p.i - tp.key_at AS s, tp.words AS tw, ws.words AS dw FROM pos p JOIN tp ON tp.key[1] = p.w JOIN ws ON ws.r = p.r WHERE ws.words[p.i + 1:p.i + len(tp.key)] = tp.key),
k AS (SELECT r, label, base, s, len(list_filter(range(0, len(tw)), lambda j: s + j >= 0 AND s + j < len(dw) AND dw[s + j + 1] = tw[j + 1]))::DOUBLE / len(tw) AS score FROM m),
g AS (SELECT r, count(*) FILTER (WHERE base) AS n_base, min(s) FILTER (WHERE base) AS first_word, max(s) FILTER (WHERE base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM k GROUP BY r)
SELECT ws.doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM ws LEFT JOIN g ON g.r = ws.r"""
