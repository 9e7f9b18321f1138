"""License scans (native: DataFrame functions only).

An exact containment join of text blocks with license templates. Blocks are lines, and windows of words
that span lines (for notices that are wrapped), as long as a text of which PERCENT percent are the template's words. The templates' tokens are
ordered by their frequency over all documents, counted first. A block that holds need = THRESHOLD
of a template's n tokens must hold one of its n - need + 1 rarest, so only these prefix tokens are
joined (with the templates, as a broadcast up to MOST_TEMPLATES of them, else by a shuffle); the length filter drops
blocks with fewer than `need` template tokens, the positional filter those whose first common token
stands too late in either order, and the rest is verified on whole token sets. Beside that, the
base phrases are found word by word in every text.

Windows go through the same filters, first with the whole document as the block, which holds each of its windows.
Of a template's windows in a document the one with most common tokens is a match (at the line it begins in), if
no line it touches has as many.

Only documents with a prefix token go on to be cut into lines; only those with a license are
joined back, by doc_id and text, so no text is shuffled.

Defined cases: a null or wordless text has 0 words, no place, no label and score 0; repeated rows
get equal results; an empty table gives an empty table; columns of the input other than doc_id and
text are not read, and names cannot clash.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save

#: what stands between words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PERCENT = 80
MOST_TEMPLATES = 10_000
#: fixed values: the base phrases and their labels
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: fixed values: notices by which licenses are declared
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
]


def words_of(text: Column) -> Column:
    """The words, with an empty one before or after them where the text begins or ends with a separator."""
    return F.split(folded(F.coalesce(text, F.lit(""))), SEPARATOR, -1)


def folded(text: Column) -> Column:
    """Lower case in A-Z only. Of other letters the Kelvin sign alone has a lower case in a-z; it stays out of the words of a template."""
    return F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u212b")))


def _tokens(text: str) -> list[str]:
    return sorted({w for w in re.split(SEPARATOR, text.lower()) if w})


def frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many documents each of these tokens stands."""
    found = docs.select(F.explode(F.array_intersect(words_of(F.col("text")), F.array(*map(F.lit, vocabulary)))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return {r.token: r.n for r in found.collect()}


def places(words: Column, lead: Column) -> Column:
    """label and start of each base phrase; phrases end with the same word, which is looked for first."""

    def at(w: Column, i: Column) -> Column:
        found = F.lit(None).cast("struct<label:string,start:bigint>")
        for phrase, label in PHRASES.items():
            *before, last = phrase.split()
            hit = (w == last) & (i >= len(before))
            for k, x in enumerate(reversed(before)):
                hit = hit & (F.get(words, i - 1 - k) == x)
            found = F.when(hit, F.struct(F.lit(label).alias("label"), (i - len(before) - lead).cast("long").alias("start"))).otherwise(found)
        return found

    return F.filter(F.transform(words, at), lambda p: p.isNotNull())


def _met(blocks: DataFrame, prefixes: DataFrame, known: DataFrame, also: str) -> DataFrame:
    """Blocks (doc_id, key, one more column and has, their template tokens, rarest first) with the templates of which they hold enough."""
    return (
        blocks.where(F.size("has") > 0)
        .select("doc_id", "key", also, "has", F.posexplode("has").alias("mine", "token"))
        .join(prefixes, "token")
        .where((F.size("has") >= F.col("need")) & (F.least(F.col("n") - F.col("at"), F.size("has") - F.col("mine")) >= F.col("need")))
        .select("doc_id", "key", also, "has", "template")
        .distinct()
        .join(known, "template")
        .withColumn("common", F.size(F.array_intersect("has", "tokens")))
        .where(F.col("common") >= F.col("need"))
    )


def _windows(text: Column, tokens: Column, reach: Column, own: Column) -> Column:
    """common and first (line, negative) of each window of `reach` words that begins with a token, spans lines and has more tokens than any of its lines in own."""
    lines = F.transform(F.split(folded(text), r"\n"), lambda low, i: F.transform(F.filter(F.split(low, SEPARATOR, -1), lambda w: w != ""), lambda w: F.struct(w.alias("w"), i.alias("line"))))
    words = F.transform(F.flatten(lines), lambda x, i: F.struct(x["w"].alias("w"), x["line"].alias("line"), i.alias("at")))
    held = F.filter(words, lambda x: F.array_contains(tokens, x["w"]))

    def over(all_: Column) -> Column:
        def window(x: Column, i: Column) -> Column:
            inside = F.filter(F.slice(all_, i + 1, reach), lambda y: y["at"] < x["at"] + reach)
            most = F.array_max(F.transform(F.filter(own, lambda o: o["line"].between(x["line"], F.element_at(inside, -1)["line"])), lambda o: o["common"]))
            common = F.size(F.array_distinct(F.transform(inside, lambda y: y["w"])))
            return F.when((F.element_at(inside, -1)["line"] > x["line"]) & (common > F.coalesce(most, F.lit(0))), F.struct(common.alias("common"), (-x["line"]).alias("first")))

        return F.transform(all_, window)

    # the array is made once: a lambda's variable holds it
    return F.flatten(F.transform(F.array(held), over))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_words, places (label, start) and matches (label, line, containment) of each row."""
    spark = docs.sparkSession
    sent = F.broadcast if len(templates) <= MOST_TEMPLATES else lambda df: df
    sets = [(i, label, _tokens(t)) for i, (label, t) in enumerate(templates)]
    vocabulary = sorted({t for *_, s in sets for t in s})
    seen = frequencies(docs, vocabulary)
    order = {t: k for k, t in enumerate(sorted(vocabulary, key=lambda t: (seen.get(t, 0), t)))}
    known, prefixes = [], []
    for i, label, tokens in sets:
        tokens = sorted(tokens, key=order.get)
        need = -(-percent * len(tokens) // 100)
        known.append((i, label, tokens, len(tokens), need, -(-100 * len(re.findall(WORD, templates[i][1].lower())) // percent)))
        prefixes += [(t, i, k, len(tokens), need) for k, t in enumerate(tokens[: len(tokens) - need + 1])]
    known = sent(spark.createDataFrame(known, "template int, label string, tokens array<string>, n int, need int, reach int"))
    rare = sorted({p[0] for p in prefixes})
    prefixes = sent(spark.createDataFrame(prefixes, "token string, template int, at int, n int, need int"))

    words = docs.select("doc_id", "text", words_of(F.col("text")).alias("words"))
    lead, size = (F.get("words", F.lit(0)) == "").cast("int"), F.size("words")
    sized = words.select(
        "doc_id",
        F.xxhash64("text").alias("key"),
        lead.alias("lead"),
        (size - lead - F.when((size > 1) & (F.element_at("words", -1) == ""), 1).otherwise(0)).cast("long").alias("n_words"),
        F.when(F.array_contains("words", "license"), F.col("words")).alias("with_license"),
    ).select("doc_id", "key", "n_words", F.coalesce(places(F.col("with_license"), F.col("lead")), F.array().cast("array<struct<label:string,start:bigint>>")).alias("places"))

    # a line's template tokens, rarest first
    ordered = F.array(*[F.lit(t) for t in sorted(order, key=order.get)])
    some = words.where(F.arrays_overlap("words", F.array(*map(F.lit, rare))))
    lines = some.select("doc_id", F.xxhash64("text").alias("key"), F.posexplode(F.split(folded(F.col("text")), r"\n")).alias("line", "low"))
    tokens = lines.select("doc_id", "key", "line", F.array_intersect(ordered, words_of(F.col("low"))).alias("has"))
    met = _met(tokens, prefixes, known, "line").select("doc_id", "key", "template", "label", "line", "n", "common")

    # windows over lines, in the documents that hold enough of a template in any place
    whole = some.where(F.instr("text", "\n") > 0).select("doc_id", F.xxhash64("text").alias("key"), "text", F.array_intersect(ordered, "words").alias("has"))
    near = _met(whole, prefixes, known, "text")
    own = met.groupBy("doc_id", "key", "template").agg(F.collect_set(F.struct("line", "common")).alias("own"))
    near = near.join(own.select(F.col("doc_id").alias("id"), F.col("key").alias("k"), F.col("template").alias("t"), "own"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("k")) & (F.col("template") == F.col("t")), "left")
    near = near.select("doc_id", "key", "template", "label", "n", "need", _windows(F.col("text"), F.col("tokens"), F.col("reach"), F.coalesce("own", F.array().cast("array<struct<line:int,common:int>>"))).alias("windows"))
    best = F.array_max(F.filter("windows", lambda w: w["common"] >= F.col("need")))
    spanning = near.select("doc_id", "key", "template", "label", "n", best.alias("best")).where("best IS NOT NULL")
    met = met.unionByName(spanning.select("doc_id", "key", "template", "label", (-F.col("best.first")).cast("int").alias("line"), "n", F.col("best.common").alias("common")))
    matches = met.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(F.struct("label", "line", (F.col("common").cast("double") / F.col("n").cast("double")).alias("containment")))).alias("matches"))
    matches = save(matches).withColumnRenamed("doc_id", "id").withColumnRenamed("key", "k")
    return sized.join(matches, sized["doc_id"].eqNullSafe(matches["id"]) & (sized["key"] == matches["k"]), "left").select("doc_id", "n_words", "places", "matches")


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.array_sort(F.array_distinct("places.label"))
    own = F.coalesce(F.col("matches.label"), F.array().cast("array<string>"))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.start").alias("first_word"), F.array_max("places.start").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("places.label", own)), ",").alias("labels"),
        F.greatest(F.when(F.size("places") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max("matches.containment"), F.lit(0.0))).alias("score"),
    )


def _oracle() -> str:
    rows = ", ".join(f"({i}, '{label}', {_tokens(t)!r})" for i, (label, t) in enumerate(TEMPLATES))
    return rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS t FROM documents
), w AS (
  SELECT doc_id, r, t, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d
), p AS (
  SELECT r, i - 1 AS start, CASE WHEN w[i] = 'mit' AND w[i + 1] = 'license' THEN 'mit' WHEN w[i] = 'apache' AND w[i + 1] = 'license' THEN 'apache'
                                 WHEN w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license' THEN 'gpl' END AS label
  FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM w)
), base AS (
  SELECT r, count(*) AS n, min(start) AS lo, max(start) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p WHERE label IS NOT NULL GROUP BY r
), line AS (
  SELECT r, regexp_extract_all(l, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM w)
), template(i, label, t) AS (VALUES {rows}
), m AS (
  SELECT r, label, len(list_intersect(t, w)) AS c, len(t) AS n FROM line, template WHERE len(w) > 0 AND 100 * len(list_intersect(t, w)) >= {PERCENT} * len(t)
), own AS (
  SELECT r, max(CAST(c AS DOUBLE) / CAST(n AS DOUBLE)) AS score FROM m GROUP BY r
), every AS (
  SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM m UNION SELECT r, label FROM p WHERE label IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(base.n, 0) AS BIGINT) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
       coalesce(base.labels, '') AS base_labels, coalesce(every.labels, '') AS labels, greatest(CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, coalesce(own.score, 0.0::DOUBLE)) AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN own USING (r) LEFT JOIN every USING (r)
"""


ORACLE_SQL = _oracle()
