"""License scans: phrases stand word by word; templates are found by an exact set-similarity join with windows of words.

A window is any run of at most `SPREAD` times as many words as a template has different ones, wherever lines end. It contains a template when it holds at least ceil(threshold x the
template's tokens) of them, among these all that tell the template from its like (the name, a version). Tokens are ordered by how many texts hold them, rarest first; such a window
must hold one of the template's first tokens - required + 1 tokens (prefix filter), so windows are looked at around the places of those alone; its text must hold enough of the
template's tokens at all (length filter), and of those after the first one met enough (positional filter); what passes is verified window by window. All is done with DataFrame
functions; templates are a table.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialise

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases and their labels.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

#: Notices that licenses ask for, their short names, and the words that tell them from their like.
TEMPLATES = [
    ("Licensed under the Apache License, Version 2.0.", "apache-2.0", "apache 2"),
    ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License", "apache-2.0", "apache 2"),
    ("Released under the MIT License.", "mit-notice", "mit"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0", "cc by nc 4"),
    ("Licensed under CC BY-SA 4.0.", "cc-by-sa-4.0", "cc by sa 4"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0", "gnu general 3"),
    ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "gpl-3.0", "gnu general 3"),
    ("This work is licensed under the GNU General Public License, version 2.", "gpl-2.0", "gnu general 2"),
    ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version", "gpl-2.0", "gnu general 2"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit-terms", "granted charge"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc", "fee"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd", "redistribution binary"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2.0", "mozilla 2"),
    ("This is free and unencumbered software released into the public domain", "unlicense", "unencumbered"),
]

#: A window has so many words at most for each different word of its template.
SPREAD = 2
#: Up to so many different template tokens are looked for in a text's row; more are joined. Up to so many prefix tokens are broadcast.
MOST_LITERALS, MOST_BROADCAST = 2000, 1 << 17
#: Up to so many rare tokens are looked for in a text as letters, before it is cut into words.
MOST_SOUGHT = 64


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def template_tokens(text: str) -> list[str]:
    return sorted(set(re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))))


def _literal(items: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in items])


def phrase_places(tokens: str, phrase: str) -> Column:
    """Starts of a phrase in a column of words."""
    parts = phrase.split()
    same = " AND ".join(f"`{tokens}`[i + {k}] = '{p}'" for k, p in enumerate(parts))
    return F.when((F.size(tokens) >= len(parts)) & F.array_contains(tokens, parts[-1]), F.expr(f"filter(sequence(0, greatest(size(`{tokens}`) - {len(parts)}, 0)), i -> {same})")).otherwise(F.array().cast("array<int>"))


def _vocabulary(templates: list[tuple[str, str, str]] | None) -> tuple[list[tuple[list[str], str, list[str]]], list[str]]:
    """(tokens, label, telling tokens) of each template that has tokens, and all their tokens."""
    found = [(template_tokens(t), label, template_tokens(own)) for t, label, own in (TEMPLATES if templates is None else templates)]
    found = [x for x in found if x[0]]
    return found, sorted({t for tokens, _, _ in found for t in tokens})


def _held(texts: DataFrame, vocabulary: list[str], *carried: str) -> DataFrame:
    """texts(doc_id, hash, tokens, ...) -> doc_id, hash, held, those of the tokens that are in the vocabulary, and the carried columns."""
    if len(vocabulary) <= MOST_LITERALS:
        return texts.select("doc_id", "hash", F.array_intersect("tokens", _literal(vocabulary).cast("array<string>")).alias("held"), *carried)
    listed = texts.sparkSession.createDataFrame([(t,) for t in vocabulary], "token string")
    sets = texts.select("doc_id", "hash", F.explode(F.array_distinct("tokens")).alias("token")).join(listed, "token", "left_semi").groupBy("doc_id", "hash").agg(F.collect_set("token").alias("held"))
    both = texts.join(sets.withColumnsRenamed({"doc_id": "s_id", "hash": "s_hash"}), F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("hash") == F.col("s_hash")), "left")
    return both.select("doc_id", "hash", F.coalesce("held", F.array().cast("array<string>")).alias("held"), *carried)


def template_matches(docs: DataFrame, threshold: float = 0.8, templates: list[tuple[str, str, str]] | None = None, held: DataFrame | None = None) -> DataFrame:
    """doc_id, hash, label, containment: every template that a window of docs(doc_id, hash, text) contains, with its best window's share.

    Containment is the share of the template's distinct words that the window holds; of several templates of one label each gives a row. Rows equal in
    doc_id and hash are one; a null text has no windows; templates without words, an empty list of them or an empty table give no rows; of equally
    frequent tokens the first by name counts as the rarer. held, where the caller has it, says which of the templates' tokens each text holds.
    """
    spark = docs.sparkSession
    templates, vocabulary = _vocabulary(templates)
    tokens_of = lambda df: df.select("doc_id", "hash", words(F.col("text")).alias("tokens"))
    held = _held(tokens_of(docs), vocabulary) if held is None else held
    fewest = min([max(1, -int(-threshold * len(t) // 1)) for t, _, _ in templates], default=1)
    counts = {r.token: r.n for r in held.where(F.size("held") >= fewest).select(F.explode("held").alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()}  # a row a template token at most
    order = {t: k for k, t in enumerate(sorted(vocabulary, key=lambda t: (counts.get(t, 0), t)))}
    sets, prefixes = [], []
    for k, (tokens, label, own) in enumerate(templates):
        ranked, need = sorted(tokens, key=order.get), max(1, -int(-threshold * len(tokens) // 1))
        sets.append((k, label, ranked, own, need, SPREAD * len(tokens)))
        prefixes += [(t, k, ranked[place:], need) for place, t in enumerate(ranked[: len(ranked) - need + 1])]
    rare = sorted({p[0] for p in prefixes})
    widest = max([w for *_, w in sets], default=1)
    sets = spark.createDataFrame(sets, "template int, label string, ranked array<string>, own array<string>, need int, width int")
    small = len(prefixes) <= MOST_BROADCAST
    prefixes = spark.createDataFrame(prefixes, "token string, template int, rest array<string>, least int")
    # Texts that have a rare token's letters at all are cut into words once more.
    low, some = F.lower("text"), docs
    if len(rare) <= MOST_SOUGHT:
        some = docs.where(F.lit(False) if not rare else functools.reduce(lambda a, b: a | b, [F.contains(low, F.lit(t)) for t in rare]))
    some = tokens_of(some).withColumn("rare", F.array_intersect("tokens", _literal(rare).cast("array<string>") if len(rare) <= MOST_LITERALS else F.lit(rare))).where(F.size("rare") > 0)
    some = _held(some, vocabulary, "tokens", "rare").where(F.size("held") >= fewest)
    # The places of rare tokens, each with the words that a window around it can reach; no row beyond this carries a whole text.
    # Columns are bound by a lambda first, and the explode is an outer one: Spark puts a column's expression in its place, also where it is worked out for each word,
    # and adds a filter to an inner explode that works its array out again.
    places = F.expr("transform(array(tokens), ts -> transform(array(rare), rs -> filter(sequence(0, size(ts) - 1), i -> array_contains(rs, ts[i])))[0])[0]")
    around = F.expr(f"transform(array(tokens), ts -> transform(at, i -> named_struct('token', ts[i], 'before', i - greatest(i - {widest - 1}, 0), 'near', slice(ts, greatest(i - {widest - 1}, 0) + 1, i - greatest(i - {widest - 1}, 0) + {widest}))))[0]")
    near = some.withColumn("at", places).select("doc_id", "hash", "held", F.explode_outer(around).alias("w")).select("doc_id", "hash", "held", "w.*")
    met = near.join(F.broadcast(prefixes) if small else prefixes, "token").where(F.size(F.array_intersect("held", "rest")) >= F.col("least")).drop("held", "rest", "least")
    both = met.join(F.broadcast(sets) if small else sets, "template")
    part = "slice(near, k + 1, width)"
    # Sliding is the dear part: first the words that any window around the place can reach must hold what a window must.
    reach = "slice(near, greatest(before - width + 1, 0) + 1, 2 * width)"
    can = f"size(array_intersect({reach}, own)) = size(own) AND size(array_intersect({reach}, ranked)) >= need"
    best = f"array_max(transform(sequence(greatest(before - width + 1, 0), before), k -> if(size(array_intersect({part}, own)) = size(own), size(array_intersect({part}, ranked)), 0)))"
    both = both.withColumn("common", F.when(F.expr(can), F.expr(best))).where("common >= need")
    return both.groupBy("doc_id", "hash", "template", "label").agg(F.max(F.col("common") / F.size("ranked")).alias("containment")).drop("template")


def scan_licenses(docs: DataFrame, threshold: float = 0.8, templates: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs(doc_id, text).

    Base labels are those of the phrases; labels add those of the templates that a window contains. Score is 1 where a phrase stands,
    else the best template's containment, else 0. Null text counts as empty: no words, no labels, score 0. Repeated rows
    and null doc_ids give a row each; columns other than doc_id and text are not read.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    tokens = rows.select("doc_id", "hash", words(F.col("text")).alias("tokens"))
    places = {label: f"at_{k}" for k, (_, label) in enumerate(PHRASES)}
    # All texts are cut into words once, for the phrases and for which of the templates' tokens they hold.
    counted = tokens.select("doc_id", "hash", "tokens", F.size("tokens").cast("long").alias("n_words"), *[phrase_places("tokens", phrase).alias(places[label]) for phrase, label in PHRASES])
    tokens = materialise(_held(counted, _vocabulary(templates)[1], "n_words", *places.values()), "words")
    found = template_matches(rows, threshold, templates, tokens.select("doc_id", "hash", "held")).groupBy("doc_id", "hash").agg(F.collect_set("label").alias("extra"), F.max("containment").alias("best"))
    every = F.concat(*[F.col(c) for c in places.values()])
    base = F.array_compact(F.array(*[F.when(F.size(c) > 0, F.lit(label)) for label, c in places.items()]))
    base_rows = tokens.select("doc_id", "hash", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), F.array_sort(base).alias("base"))
    joined = base_rows.join(found.withColumnsRenamed({"doc_id": "f_id", "hash": "f_hash"}), F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("hash") == F.col("f_hash")), "left")
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("extra", F.array().cast("array<string>")))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
