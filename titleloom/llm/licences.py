"""Licence notices in texts by diagonal voting over word k-grams; DataFrame functions only.

A template is a short run of words. Every rolling k-gram of a text (three
words, two for templates of two) is joined by its hash to the positions of the
templates' k-grams and checked word by word. Hits vote for the diagonal, text
position minus template position. Neighbouring diagonals of a template merge
into a span (inserted or missing words shift the diagonal), and a span counts
when enough of the template and of the span is covered by hits.

Words: A-Z lower-cased, everything of ASCII but letters and digits between them.

Results: one row per input row. Null and empty texts have no words and no
spans. Null and repeated ids stay apart: rows are told apart by a number of
their own. An empty table gives no rows. Other columns are not read.

One pass over the texts; the templates, a fixed parameter (BOUND words at
most), are broadcast. Only hits and one head row per document are shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from titleloom.llm.common import LOWER, UPPER, documents, query

K = 3
COVERAGE = 0.8
BOUND = 20_000
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# Notices as their publishers word them.
NOTICES = (
    ("Licensed under the Apache License, Version 2.0", "apache-2.0"),
    ("you may not use this file except in compliance with the License. You may obtain a copy of the License at", "apache-2.0"),
    ("Released under the MIT License", "mit"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the GNU General Public License, version 3", "gpl-3.0"),
    ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gpl-family"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc-4.0"),
    ("Licensed under CC BY 4.0", "cc-by-4.0"),
    ("Licensed under CC BY-SA 4.0", "cc-by-sa-4.0"),
    ("licensed under a Creative Commons Attribution 4.0 International License", "cc-by-4.0"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl-2.0"),
    ("This is free and unencumbered software released into the public domain", "unlicense"),
)
BREAKS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def words_of(text: Column) -> Column:
    plain = F.translate(text, UPPER + BREAKS, LOWER + " " * len(BREAKS))
    return F.array_remove(F.split(plain, " "), "")


def _template_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c in UPPER else c for c in text))


def _grams(spark: SparkSession, templates: list[tuple[str, str, bool]]) -> DataFrame:
    """h -> places: (template, label, base, m, tpos, words) of the grams with that hash."""
    rows = []
    for number, (text, label, base) in enumerate(templates):
        words = _template_words(text)
        if len(words) < 2:
            raise ValueError(f"a template needs two words: {text!r}")
        k = min(K, len(words))
        for at in range(len(words) - k + 1):
            gram = [*words[at : at + k], *[None] * (K - k)]
            rows.append((number, label, base, len(words), k, at, *gram))
    if len(rows) > BOUND:
        raise ValueError("more template words than may be broadcast")
    sql = ", ".join(
        "(" + ", ".join("CAST(NULL AS STRING)" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "\\'") + "'" for v in r) + ")"
        for r in rows
    )
    grams = spark.sql(f"SELECT * FROM VALUES {sql} AS t(template, label, base, m, k, tpos, w1, w2, w3)")
    place = F.struct("template", "label", "base", "m", "k", "tpos", "w1", "w2", "w3")
    return grams.groupBy("k", F.xxhash64("w1", "w2", "w3").alias("h")).agg(F.collect_list(place).alias("places"))


def scan(
    docs: DataFrame, templates: tuple = NOTICES, base: tuple = BASE, id_col: str = "doc_id", text_col: str = "text",
    coverage: float = COVERAGE,
) -> DataFrame:
    """doc_id, n_words and spans: array of (start, end, label, base, covered) of every verified notice; words from 0."""
    every = [(t, label, True) for t, label in base] + [(t, label, False) for t, label in templates]
    grams = _grams(docs.sparkSession, every)
    of = lambda k: F.broadcast(grams.where(F.col("k") == k).select(F.col("h").alias(f"h{k}"), F.col("places").alias(f"places{k}")))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    rows = rows.select("rid", "doc_id", F.coalesce(F.size("words"), F.lit(0)).alias("size"), "words", F.posexplode_outer("words").alias("pos", "g1"))
    rows = rows.select(
        "rid", "doc_id", F.greatest("size", F.lit(0)).cast("long").alias("n_words"), "pos", "g1",
        F.get("words", F.col("pos") + 1).alias("g2"), F.get("words", F.col("pos") + 2).alias("g3"),
    )
    rows = rows.withColumn("h2", F.xxhash64("g1", "g2")).withColumn("h3", F.xxhash64("g1", "g2", "g3"))
    rows = rows.join(of(2), "h2", "left").join(of(3), "h3", "left")
    rows = rows.where("places2 IS NOT NULL OR places3 IS NOT NULL OR coalesce(pos, 0) = 0")
    none = F.array().cast(grams.schema["places"].dataType)
    same = lambda p: (p.w1 == F.col("g1")) & (p.w2 == F.col("g2")) & ((p.k == 2) | (p.w3 == F.col("g3")))
    places = F.filter(F.concat(F.coalesce("places2", none), F.coalesce("places3", none)), same)
    hits = rows.select("rid", "doc_id", "n_words", "pos", F.explode_outer(places).alias("p")).repartition("rid")
    hits = hits.select("rid", "doc_id", "n_words", "pos", "p.template", "p.label", "p.base", "p.m", "p.k", "p.tpos")
    doc = ["rid", "doc_id", "n_words"]
    template = ["template", "label", "base", "m", "k"]
    votes = hits.groupBy(*doc, *template, (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.collect_list(F.struct("pos", "tpos")).alias("hits"))
    slack = F.col("m") / 4
    before = F.expr("lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal)")
    votes = votes.withColumn("first", F.when(before.isNull() | (F.col("diagonal") - before > slack), 1).otherwise(0))
    votes = votes.withColumn("span", F.expr("sum(first) OVER (PARTITION BY rid, template ORDER BY diagonal)"))
    spans = votes.groupBy(*doc, *template, "span").agg(F.flatten(F.collect_list("hits")).alias("hits"))
    covered = lambda name: F.size(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h[name], h[name] + F.col("k") - 1)))))
    spans = spans.withColumn("start", F.array_min("hits.pos")).withColumn("end", F.array_max("hits.pos") + F.col("k"))
    spans = spans.withColumn("covered", F.least(covered("tpos") / F.col("m"), covered("pos") / (F.col("end") - F.col("start"))))
    good = F.when(F.col("covered") >= coverage, F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "label", "base", "covered"))
    return spans.groupBy(*doc).agg(F.array_sort(F.collect_list(good)).alias("spans")).drop("rid")


def _oracle() -> str:
    """The same scan over word lists; ids are unique in documents."""
    rows = []
    for number, (text, label, base) in enumerate([*((t, label, True) for t, label in BASE), *((t, label, False) for t, label in NOTICES)]):
        words = _template_words(text)
        k = min(K, len(words))
        for at in range(len(words) - k + 1):
            gram = [f"'{w}'" for w in words[at : at + k]] + ["NULL"] * (K - k)
            rows.append(f"({number}, '{label}', {base}, {len(words)}, {k}, {at}, {', '.join(gram)})")
    return f"""WITH t(template, label, base, m, k, tpos, w1, w2, w3) AS (VALUES {', '.join(rows)}),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS w1, generate_subscripts(w, 1) AS i, w FROM d),
hits AS (SELECT doc_id, template, label, base, m, k, i - 1 AS pos, tpos, i - 1 - tpos AS diagonal FROM p JOIN t ON p.w1 = t.w1 AND p.w[i + 1] = t.w2 AND (t.k = 2 OR p.w[i + 2] = t.w3)),
g AS (SELECT DISTINCT doc_id, template, m, diagonal FROM hits),
f AS (SELECT *, CASE WHEN lag(diagonal) OVER o IS NULL OR diagonal - lag(diagonal) OVER o > m / 4 THEN 1 ELSE 0 END AS first FROM g WINDOW o AS (PARTITION BY doc_id, template ORDER BY diagonal)),
s AS (SELECT *, sum(first) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM f),
u AS (SELECT h.doc_id, h.template, label, base, h.m, k, span, pos, tpos, unnest(range(k)) AS j FROM hits h JOIN s ON h.doc_id = s.doc_id AND h.template = s.template AND h.diagonal = s.diagonal),
v AS (SELECT doc_id, label, base, min(pos) AS start, least(count(DISTINCT tpos + j) / m, count(DISTINCT pos + j) / (max(pos) + k - min(pos))) AS covered FROM u GROUP BY doc_id, template, label, base, m, k, span),
z AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
 string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(covered) AS score FROM v WHERE covered >= {COVERAGE} GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score FROM d LEFT JOIN z USING (doc_id)"""


@query("op2_license_scan", _oracle())
def op2_license_scan(spark, sf_dir):
    base = F.filter("spans", lambda s: s.base)
    joined = lambda spans: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(spans, lambda s: s.label))))
    starts = F.transform(base, lambda s: s.start)
    return scan(documents(spark, sf_dir)).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s.covered)), F.lit(0.0)).alias("score"),
    )
