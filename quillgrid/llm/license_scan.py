"""License scan in DataFrame operations only: phrase places, and an exact set-similarity join of text blocks with templates.

A block for a template is any run of as many consecutive words as the template has, divided by
``threshold`` (or the whole text if that is shorter), across lines. It matches if it has at least
``threshold`` of the template's distinct words (containment), among them those that tell the template
from its like. Template words are ordered by how many documents have them, rarest first: a block that
reaches o = ceil(threshold * |T|) common words has one of the first |T| - o + 1 words of T (prefix
filter), so only the surroundings of such words are looked at; these are tested for all the common
words and own words that they can hold (length and positional filters), then block by block.

The text is read and cut into words once: what is kept of a document is its row of the result, which
of the templates' words it has, and its words only where it has enough of a template's. No step
compares blocks with each other or sends a text through a shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, as_id, key_id, materialise

#: The phrases of the contract and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Short notices of common licenses, and the words without which a block is not the notice.
TEMPLATES = [
    ("mit", "Released under the MIT License", "mit"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "obtaining"),
    ("apache", "Licensed under the Apache License, Version 2.0", "apache"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", "general public"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License", "general public"),
    ("lgpl", "licensed under the GNU Lesser General Public License", "lesser"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", "cc nc"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", "commons attribution"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", "redistribution"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License", "mozilla"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "fee"),
    ("unlicense", "This is free and unencumbered software released into the public domain", "unencumbered"),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The characters beyond ASCII whose lower case has a letter of ASCII.
_FOLDING = ("İ", "K")


def folded(text: Column) -> Column:
    """A-Z in lower case; other characters too where that makes no letter of ASCII: words are as many, and those of ASCII the same."""
    odd = text.contains(_FOLDING[0]) | text.contains(_FOLDING[1])
    return F.when(odd, F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def _plain(text: str) -> list[str]:
    return "".join(c.lower() if c.isalnum() else " " for c in text).split()


def template_words(text: str) -> list[str]:
    """The distinct words of a template, which is plain ASCII."""
    return list(dict.fromkeys(_plain(text)))


def _shape(text: str, threshold: float) -> tuple[list[str], int, int]:
    """Distinct words, how many of them are needed, and the words of a block."""
    words = template_words(text)
    return words, max(1, math.ceil(threshold * len(words) - 1e-9)), math.ceil(len(_plain(text)) / threshold - 1e-9)


def _phrases(words: Column) -> dict[str, Column]:
    """Places, first and last start and labels of the fixed phrases, for texts that have the word license."""
    # " w1  w2  w3 ": every word has its own two spaces, so equal phrases in a row do not overlap
    low = F.when(F.array_contains(words, "license"), F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" ")))
    spaces = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    places, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        wrapped = " " + phrase.replace(" ", "  ") + " "
        has = F.coalesce(low.contains(wrapped), F.lit(False))
        n = (F.length(low) - F.length(F.replace(low, F.lit(wrapped), F.lit("")))) / F.lit(len(wrapped))
        places.append(F.when(has, n.cast("long")).otherwise(0))
        firsts.append(F.when(has, (spaces(F.substring_index(low, wrapped, 1)) / 2).cast("long")))
        k = len(phrase.split())
        lasts.append(F.when(has, ((spaces(low) - spaces(F.substring_index(low, wrapped, -1))) / 2).cast("long") - k))
        labels.append(F.when(has, F.lit(label)))
    return {
        "n_base": sum(places, F.lit(0)).cast("long"), "first_word": F.least(*firsts), "last_word": F.greatest(*lasts),
        "base": F.array_sort(F.array_compact(F.array(*labels))),
    }


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def read_once(documents: DataFrame, templates=TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """doc_key, mark (the text's hash), n_words, base figures, seen (the templates' words there), and words: the text's
    words where it has enough of some template's, else null. Written to the shared folder."""
    shapes = [_shape(text, threshold) for _, text, _ in templates]
    vocabulary = sorted({w for words, _, _ in shapes for w in words})
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(key_id().alias("doc_key"), F.xxhash64(text).alias("mark"), F.array_remove(F.split(folded(text), SEPARATORS), "").alias("words"))
    rows = rows.withColumn("seen", F.array_intersect("words", _strings(vocabulary)))
    enough = F.lit(False)
    for words, need, _ in shapes:
        enough = enough | (F.size(F.array_intersect("seen", _strings(words))) >= need)
    return materialise(rows.select(
        "doc_key", "mark", F.size("words").cast("long").alias("n_words"), *[c.alias(n) for n, c in _phrases(F.col("words")).items()],
        "seen", F.when(enough, F.col("words")).alias("words"),
    ), "licenses")


def word_frequency(read: DataFrame) -> dict[str, int]:
    """Documents that have each of the templates' words (at most as many rows as there are such words)."""
    return {r.word: r["count"] for r in read.select(F.explode("seen").alias("word")).groupBy("word").count().collect()}


def _index(spark, templates, frequency: dict[str, int], threshold: float) -> DataFrame:
    """One row for each prefix word of each template: words and own words of the template, words needed, words of a block."""
    rows = []
    for number, (label, text, own) in enumerate(templates):
        words, need, block = _shape(text, threshold)
        words = sorted(words, key=lambda w: (frequency.get(w, 0), w))
        rows += [(w, number, label, need, block, words, own.split()) for w in words[: len(words) - need + 1]]
    return spark.createDataFrame(rows, "word string, template int, label string, need int, block int, template_words array<string>, own array<string>")


def matches(read: DataFrame, templates=TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """doc_key, mark, label, containment: the best of each label in each text."""
    index = _index(read.sparkSession, templates, word_frequency(read), threshold)
    prefix = sorted({r.word for r in index.select("word").distinct().collect()})
    near = read.filter(F.col("words").isNotNull()).select("doc_key", "mark", "words", F.posexplode("words").alias("at", "word")).filter(F.col("word").isin(prefix))
    joined = near.join(F.broadcast(index), "word")  # at most as many rows as the templates have words
    # the words around the prefix word that a block with it can have
    begin = F.greatest(F.col("at") - F.col("block") + 1, F.lit(0))
    around = joined.select("doc_key", "mark", "label", "need", "block", "template_words", "own", (F.col("at") - begin + 1).alias("starts"), F.slice("words", begin + 1, F.col("at") - begin + F.col("block")).alias("around"))
    around = around.filter((F.size(F.array_intersect("around", "template_words")) >= F.col("need")) & (F.size(F.array_except("own", "around")) == 0))
    blocks = F.transform(F.sequence(F.lit(1), "starts"), lambda i: F.slice("around", i, F.col("block")))
    common = F.transform(F.filter(blocks, lambda b: F.size(F.array_except("own", b)) == 0), lambda b: F.size(F.array_intersect(b, F.col("template_words"))))
    found = around.withColumn("common", F.array_max(common)).filter(F.col("common") >= F.col("need"))
    return found.groupBy("doc_key", "mark", "label").agg(F.max(F.col("common") / F.size("template_words")).alias("containment"))


def scan(documents: DataFrame, templates=TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    Templates are (label, notice, own words). score: 1 with a base phrase, else the largest containment found,
    else 0. Null and empty texts have no words and no labels. Repeated rows come back as often as they came in;
    labels belong to (id, text), so rows that share an id but not the text stay apart. An empty table gives none.
    """
    read = read_once(documents, templates, threshold)
    labels = matches(read, templates, threshold).groupBy("doc_key", "mark").agg(
        F.collect_set("label").alias("more"), F.max("containment").alias("containment")
    )
    both = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return read.drop("seen", "words").join(labels, ["doc_key", "mark"], "left").select(
        as_id("doc_key").alias("doc_id"), "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )


def oracle(threshold: float = 0.8) -> str:
    """The same in DuckDB's SQL, comparing every block with every template."""
    words = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    shapes = [(label, *_shape(text, threshold), own.split()) for label, text, own in TEMPLATES]
    rows = ", ".join(f"('{label}', {tw!r}, {need}, {block}, {own!r})" for label, tw, need, block, own in shapes)
    starts = " UNION ALL ".join(
        f"SELECT doc_id, '{label}' AS label, i - 1 AS pos FROM w, UNNEST(range(1, len(ws) + 1)) AS u(i) WHERE hit AND "
        + " AND ".join(f"ws[i + {k}] = '{x}'" for k, x in enumerate(phrase.split()))
        for phrase, label in PHRASES.items()
    )
    return f"""
    WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
    w AS (SELECT doc_id, regexp_extract_all(t, {words}) AS ws, contains(t, 'license') AS hit FROM d),
    templates(label, tw, need, block, own) AS (VALUES {rows}),
    p AS ({starts}),
    base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY doc_id),
    c AS (SELECT doc_id, ws, label, tw, need, block, own FROM w, templates
          WHERE len(list_intersect(tw, ws)) >= need AND len(list_intersect(own, ws)) = len(own)),
    b AS (SELECT doc_id, label, tw, need, own, ws[i : i + block - 1] AS bw FROM c, UNNEST(range(1, len(ws) + 1)) AS u(i)),
    m AS (SELECT doc_id, label, max(len(list_intersect(tw, bw)) / len(tw)) AS containment
          FROM b WHERE len(list_intersect(tw, bw)) >= need AND len(list_intersect(own, bw)) = len(own) GROUP BY ALL),
    a AS (SELECT doc_id, label FROM p UNION SELECT doc_id, label FROM m),
    labels AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM a GROUP BY doc_id),
    best AS (SELECT doc_id, max(containment) AS containment FROM m GROUP BY doc_id)
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
           coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
           CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(containment, 0) END::DOUBLE AS score
    FROM w LEFT JOIN base USING (doc_id) LEFT JOIN labels USING (doc_id) LEFT JOIN best USING (doc_id)"""
