"""Licence statements in texts: phrases word for word, and an exact set-similarity join with templates.

All of it is DataFrame expressions. A template is a set of words; a text block is a window of
2 * L words that begins at a multiple of L, L being the least power of two, 16 or more, that the
template's words fit, so that every run of words as long as the template lies whole in a block.
A block holds a template if it contains the least share of its words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The phrases that are looked for word for word, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Statements and the openings of public licences, with their labels.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nd", "creative commons attribution noderivatives 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("reserved", "no part of this publication may be reproduced distributed or transmitted in any form or by any means without the prior written permission of the publisher"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


APART = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def lowered(text: Column, plain: bool = True) -> Column:
    """The text (null: empty) with A-Z in lower case, and without ASCII signs at its ends.

    plain: it will be compared with ASCII words alone. Then the general lower case does as well,
    for the Kelvin sign alone becomes an ASCII letter by it.
    """
    text = F.trim(F.coalesce(text, F.lit("")), F.lit(APART))
    exact = F.translate(text, UPPER, LOWER)
    return F.when(F.contains(text, F.lit("\u212a")), exact).otherwise(F.lower(text)) if plain else exact


def words_of(low: Column) -> Column:
    """The words of a lowered text: ASCII signs other than letters and digits part them."""
    return F.when(low != "", F.split(low, BETWEEN)).otherwise(F.array().cast("array<string>"))


def literal(words: list[str]) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def places(low: Column, words: Column, phrase: str) -> Column:
    """Where the phrase begins, words counted from 0; texts without all its words are not walked."""
    parts = phrase.split()
    there = F.size(words) >= len(parts)
    for p in parts:
        there = there & F.contains(low, F.lit(p))

    def stands(i: Column) -> Column:
        hit = F.lit(True)
        for k, p in enumerate(parts):
            hit = hit & (F.get(words, i + k) == p)
        return hit

    found = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), stands)
    return F.when(there, found).otherwise(F.array().cast("array<int>"))


def needed(n: int, least: float, short: int) -> int:
    """Words of a template of n that a block must contain."""
    return n if n < short else math.ceil(least * n - 1e-9)


def step_of(text: str) -> int:
    return 1 << max(4, (len(text.split()) - 1).bit_length())


def no_blocks() -> Column:
    return F.array().cast("array<struct<step:int,must:int,own:array<string>>>")


def starts(step: int) -> Column:
    return F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(step))


def block_of(step: int, must: int, within: list[str]):
    """From where a block begins to the block: which words of `within`, in their order, it contains."""
    return lambda at: F.struct(F.lit(step).alias("step"), F.lit(must).alias("must"), F.array_intersect(literal(within), F.slice("words", at + 1, 2 * step)).alias("own"))


def rarest_first(rows: DataFrame, vocabulary: list[str]) -> list[str]:
    """The templates' words by the number of texts that hold them, counted over all texts; ties by the word.

    What comes to the driver is one number a word of the templates, however many texts there are.
    """
    held = rows.select(F.explode(F.array_intersect(literal(vocabulary), "words")).alias("word"))
    n = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (n.get(w, 0), w))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = 0.8, short: int = 10) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of PHRASES, first_word and last_word are the smallest and largest of
    them (words from 0; null if none). labels adds those of templates (`least` of their words in a
    block; all of them if the template has fewer than `short` words, for there one word names the
    licence). score: the greatest share of a template that was found, 1 where a phrase stands,
    else 0.

    The join is exact. Words are ordered by their number of texts, rarest first. A block and a
    template that share enough words share one among the first of each in that order (prefix);
    blocks with too few words of the templates are left out (length), and pairs whose words
    behind the shared one are too few (position); what is left is counted out.

    One row for each row of docs: repeated rows and doc_ids stand for themselves, a null doc_id
    stays null, a null or empty text has no words, empty labels and score 0; an empty table gives
    an empty result. Other columns are not read. A text of any length is one row, and its words
    one array; its blocks are exploded only if it holds a prefix word.
    """
    templates = TEMPLATES if templates is None else templates
    plain = all(t.isascii() for _, t in templates)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lowered(F.col("text"), plain).alias("low")).withColumn("words", words_of(F.col("low")))
    sets = [(label, step_of(text), sorted(set(text.split()))) for label, text in templates]
    order = rarest_first(rows, sorted({w for _, _, s in sets for w in s}))
    rank = {w: k for k, w in enumerate(order)}
    index, prefixes = [], {}
    for no, (label, step, s) in enumerate(sets):
        s, must = sorted(s, key=rank.get), needed(len(s), least, short)
        for at, w in enumerate(s[: len(s) - must + 1]):
            index.append((w, step, no, at, len(s), must, label, s))
            prefixes.setdefault(step, set()).add(w)
    base = base_columns(rows.withColumn("row", F.monotonically_increasing_id()))
    blocks = no_blocks()
    for step in sorted(prefixes):
        within = [w for w in order if any(w in s for _, k, s in sets if k == step)]
        must = min(needed(len(s), least, short) for _, k, s in sets if k == step)
        long_enough = F.filter(F.transform(starts(step), block_of(step, must, within)), lambda b: F.size(b["own"]) >= b["must"])
        blocks = F.concat(blocks, long_enough)
    every = sorted({w for prefix in prefixes.values() for w in prefix})
    blocks = F.when(F.arrays_overlap("words", literal(every)), blocks).otherwise(no_blocks())
    kept = ["row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base"]
    each = base.select(*kept, F.explode_outer(blocks).alias("block"))
    longest = F.size("block.own") - F.col("block.must") + 1  # no template of the step has a longer prefix in it
    each = each.select(*kept, "block", F.posexplode_outer(F.when(F.col("block").isNotNull(), F.slice("block.own", 1, longest))).alias("i", "word"))
    spark = docs.sparkSession
    ddl = "t_word string, t_step int, no int, j int, n int, must int, label string, t_words array<string>"
    table = F.broadcast(spark.createDataFrame(index, ddl))  # a row a prefix word of a template
    own = F.size("block.own")
    behind = F.least(own - F.col("i"), F.col("n") - F.col("j"))
    fits = (F.col("word") == F.col("t_word")) & (F.col("block.step") == F.col("t_step"))
    met = each.join(table, fits & (F.col("i") <= own - F.col("must")) & (behind >= F.col("must")), "left")
    shared = F.size(F.array_intersect("block.own", "t_words"))
    met = met.withColumn("share", F.when(shared >= F.col("must"), shared / F.col("n")))
    by = met.groupBy(*kept).agg(F.collect_set(F.when(F.col("share").isNotNull(), F.col("label"))).alias("more"), F.max("share").alias("share"))
    labels = F.array_join(F.array_sort(F.array_union("base", "more")), ",")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0)))
    return by.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), labels.alias("labels"), score.alias("score"))


def base_columns(rows: DataFrame) -> DataFrame:
    """rows(low, words, ...) with n_words, n_base, first_word, last_word and `base`, the sorted labels of PHRASES."""
    found = rows.withColumns({f"at{k}": places(F.col("low"), F.col("words"), p) for k, p in enumerate(PHRASES)})
    at = [F.col(f"at{k}") for k in range(len(PHRASES))]
    n = sum((F.size(a) for a in at), F.lit(0))
    names = F.array(*(F.when(F.size(a) > 0, name) for a, name in zip(at, PHRASES.values())))
    return found.select(
        *rows.columns,
        F.size("words").cast("long").alias("n_words"),
        n.cast("long").alias("n_base"),
        F.array_min(F.concat(*at)).cast("long").alias("first_word"),
        F.array_max(F.concat(*at)).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(names))).alias("base"),
    )


def brute_sql(least: float = 0.8, short: int = 10) -> str:
    """The same result in DuckDB's SQL, every block against every template."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    sets = ", ".join(f"('{label}', {step_of(t)}, {needed(len(set(t.split())), least, short)}, {quoted(sorted(set(t.split())))})" for label, t in TEMPLATES)
    stands = " UNION ALL ".join(
        f"SELECT row, '{label}' AS label, i FROM (SELECT row, words, unnest(range(len(words) - {len(p.split()) - 1})) AS i FROM w WHERE {' AND '.join(f'list_contains(words, {chr(39)}{x}{chr(39)})' for x in p.split())}) s"
        f" WHERE {' AND '.join(f'words[i + {k + 1}] = {chr(39)}{x}{chr(39)}' for k, x in enumerate(p.split()))}"
        for p, label in PHRASES.items()
    )
    return rf"""WITH w AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
    p AS ({stands}), b AS (SELECT row, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list_distinct(list(label))) AS base FROM p GROUP BY row),
    t(label, step, must, words) AS (VALUES {sets}),
    k AS (SELECT row, step, list_slice(words, f + 1, f + 2 * step) AS part FROM (SELECT row, words, step, unnest(range(0, greatest(len(words), 1), step)) AS f FROM w, (SELECT DISTINCT step FROM t) s) x),
    m AS (SELECT k.row, label, len(list_intersect(part, t.words)) AS shared, must, len(t.words) AS n FROM k JOIN t USING (step)),
    l AS (SELECT row, list(DISTINCT label) AS more, max(CAST(shared AS DOUBLE) / n) AS share FROM m WHERE shared >= must GROUP BY row)
    SELECT doc_id, CAST(len(w.words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(coalesce(base, []), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ',') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS score
    FROM w LEFT JOIN b USING (row) LEFT JOIN l USING (row)"""
