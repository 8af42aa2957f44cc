"""License scans: phrases in place, and an exact containment join of text blocks with license templates.

Blocks are all runs of as many words as the longest template has, wherever
lines break. The tokens of the templates are ordered by their frequency over
all texts, rarest first. A block holds a template at threshold t if it has at
least ceil(t * size) of its distinct tokens, so it must have one of the
template's size - ceil(t * size) + 1 rarest: the prefix. Each place of a prefix
token is joined by equality with the templates that have it there. If it is the
rarest token that block and template share, the shared ones come from it on in
that order: the length filter counts these near the place, the positional
filter only those that one run with the place in it can reach, and what passes
is counted run by run.

Texts are split into words once; what goes on are the places of the templates'
words. Only built-in functions are used; no text is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import broadcast_if_small, let, materialize, table

WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (label, phrase): the places of these phrases are the base.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: (label, text of a notice): the templates of the containment join.
TEMPLATES = (
    ("mit", "released under the MIT License"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the Apache License"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc-by-sa", "Creative Commons Attribution ShareAlike 4.0 International License"),
    ("gpl-3", "this work is licensed under the GNU General Public License, version 3"),
    ("gpl", "under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the Mozilla Public License, v. 2.0"),
)
THRESHOLD = 0.9


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased. lower() gives the same words up to letters outside ASCII, except for two that become ASCII."""
    odd = text.contains("K") | text.contains("İ")
    return F.when(odd, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WORD_BREAK, -1), lambda w: w != "")


def _tokens(phrase: str) -> list[str]:
    return [w for w in re.split(WORD_BREAK, phrase.lower()) if w]


def _starts(words: Column, joined: Column, phrase: str) -> Column:
    """Numbers of the words at which the phrase starts; looked for only where the joined words contain it."""
    parts = _tokens(phrase)

    def here(i: Column) -> Column:
        hit = F.get(words, i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            hit = hit & (F.get(words, i + k) == p)
        return hit

    n = F.size(words) - len(parts)
    return F.when(joined.contains(f" {' '.join(parts)} "), F.filter(F.sequence(F.lit(0), n), here)).otherwise(F.array().cast("array<int>"))


def _phrase_places(w: Column, phrases: Sequence[tuple[str, str]]) -> Column:
    """Struct of n_words, n_base, first_word, last_word and base_list for the words of one text."""
    return let(F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" ")), lambda j: let(
        F.array(*[_starts(w, j, p) for _, p in phrases]),
        lambda found: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + F.size(x)).alias("n_base"),
            F.array_min(F.flatten(found)).cast("long").alias("first_word"),
            F.array_max(F.flatten(found)).cast("long").alias("last_word"),
            F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(F.size(F.get(found, F.lit(k))) > 0, F.lit(label)) for k, (label, _) in enumerate(phrases)]), lambda x: x.isNotNull()))).alias("base_list"),
        ),
    ))


def read_words(docs: DataFrame, key: str, text: str, phrases: Sequence[tuple[str, str]], vocabulary: Sequence[str]) -> DataFrame:
    """key, p (struct of the phrases' places) and hits: places and words of the text that are in the vocabulary, in order."""
    def of(w: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i).isin(*vocabulary))
        hits = F.when(F.size(w) > 0, F.transform(at, lambda i: F.struct(i.alias("i"), F.get(w, i).alias("w"))))
        return F.struct(_phrase_places(w, phrases).alias("p"), F.coalesce(hits, F.array().cast("array<struct<i:int,w:string>>")).alias("hits"))

    read = let(words_of(lower_ascii(F.coalesce(F.col(text), F.lit("")))), of)
    return docs.select(F.col(key), read.alias("r")).select(key, "r.p", "r.hits")


def containment_join(words: DataFrame, key: str, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(key, template, label, first_word, containment) of the templates that some block of a text holds to ``threshold``, with the best block and its first shared word.

    ``words`` come from ``read_words`` with the templates' vocabulary;
    ``template`` is its number. Texts without words have no blocks. Rows that
    share a key count as one.
    """
    spark = words.sparkSession
    sets = [(k, label, sorted(set(_tokens(body)))) for k, (label, body) in enumerate(templates)]
    run = max((len(_tokens(body)) for _, body in templates), default=0)
    vocabulary = sorted({w for _, _, s in sets for w in s})
    # One row per token of the templates: bounded by their vocabulary.
    frequency = dict(words.select(F.explode("hits.w").alias("t")).groupBy("t").count().collect())
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
    rows = []
    for k, label, s in sets:
        ranked = sorted(s, key=order.get)
        need = -(-round(threshold * len(s) * 1_000_000) // 1_000_000)
        rows += [(k, label, ranked[i:], need, len(s), ranked[i]) for i in range(len(s) - need + 1)]
    index = spark.createDataFrame(rows, "template int, label string, rest array<string>, need int, size int, token string")
    prefix = sorted({r[-1] for r in rows})
    # Each hit is a word of its own, so a block's hits are at most ``run`` hits away.
    place = F.filter(F.sequence(F.lit(0), F.size("hits") - 1), lambda j: F.get("hits", j)["w"].isin(*prefix))
    anchors = words.where(F.exists("hits", lambda h: h["w"].isin(*prefix))).select(key, "hits", F.explode(place).alias("j")).select(
        key, F.get("hits", F.col("j"))["w"].alias("token"), F.get("hits", F.col("j"))["i"].alias("at"), F.slice("hits", F.greatest(F.lit(1), F.col("j") + 2 - run), F.lit(2 * run - 1)).alias("near")
    )
    near = F.filter("near", lambda h: F.array_contains("rest", h["w"]) & (F.abs(h["i"] - F.col("at")) < run))
    blocks = (
        anchors.join(broadcast_if_small(index), "token")
        .where(F.size("near") >= F.col("need"))
        .select(key, "template", "label", "need", "size", "at", near.alias("near"))
        .where(F.size(F.array_distinct("near.w")) >= F.col("need"))
    )
    # A run may begin at a shared word: the first at or before the place.
    starts = F.filter("near", lambda h: h["i"] <= F.col("at"))
    shared = F.transform(starts, lambda s: F.struct(F.size(F.array_distinct(F.transform(F.filter("near", lambda h: (h["i"] >= s["i"]) & (h["i"] < s["i"] + run)), lambda h: h["w"]))).alias("n"), (-s["i"]).alias("start")))
    best = blocks.select(key, "template", "label", "need", "size", F.array_max(shared).alias("best")).where(F.col("best.n") >= F.col("need"))
    return best.groupBy(key, "template", "label", "size").agg(F.max("best").alias("best")).select(
        key, "template", "label", (-F.col("best.start")).cast("long").alias("first_word"), (F.col("best.n") / F.col("size")).alias("containment")
    )


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: counts and places of the phrases, labels of phrases and templates, score.

    score is 1 where a phrase stands, else the largest containment found, else
    0. Null texts count as empty: no words, null places, empty labels. Equal
    rows give equal rows; rows that share a key share the template labels of
    all of them. Extra columns are left out.
    """
    vocabulary = sorted({w for _, body in templates for w in _tokens(body)})
    words = materialize(read_words(docs, key, text, phrases, vocabulary).withColumnRenamed(key, "key"))
    found = containment_join(words, "key", templates, threshold).groupBy("key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("most"))
    base, found = words.select("key", "p").alias("b"), found.alias("f")
    return base.join(found, F.col("b.key").eqNullSafe(F.col("f.key")), "left").select(
        F.col("b.key").alias(key), "p.n_words", "p.n_base", "p.first_word", "p.last_word",
        F.array_join("p.base_list", ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("p.base_list", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.col("p.n_base") > 0, 1.0).otherwise(F.coalesce("most", F.lit(0.0))).alias("score"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents", "doc_id", "text"))
