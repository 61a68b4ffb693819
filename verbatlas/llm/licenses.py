"""License scans by diagonal voting, in DataFrame operations only.

Every rolling k-gram of words of every whole text is hashed; those that some
template has (a fixed small set, tested within the row) are kept with their places
and joined to the template positions, a small table that is broadcast. A match at
word d of a text and word t of a template votes for the diagonal d - t.
Votes are added up by (text, template, diagonal); diagonals at most ``gap`` apart
are merged, so inserted or lost words don't break a span; a merged span is
verified if it covers enough of the template's k-grams and isn't much longer than
the template. Words are made once a text, in one pass without any shuffle, which
writes a narrow row a text; only matches become rows of their own and are grouped.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verbatlas.llm.common import materialise

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Notices as their publishers word them.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    (
        "apache",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
)


@dataclass(frozen=True)
class Voting:
    """``k`` words a gram; ``gap`` between diagonals merged; ``cover`` of a template's k-grams; ``stretch`` of a span's length."""

    k: int = 4
    gap: int = 3
    cover: float = 0.75
    stretch: float = 1.5


def template_words(text: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, text.lower()) if w]


def words(text: Column) -> Column:
    """Words of a text, null as empty. Lower-casing beyond A-Z never makes or breaks a word."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS, -1)
    head, tail = (F.element_at(parts, 1) == "").cast("int"), (F.element_at(parts, -1) == "").cast("int")
    return F.slice(parts, head + 1, F.greatest(F.size(parts) - head - tail, F.lit(0)))


def base_places(text: Column, w: Column) -> Column:
    """(start, label) of every base phrase, in order; texts without the word ``license`` are not walked."""
    place = lambda at, label: F.struct(at.cast("long").alias("start"), F.lit(label).alias("label"))

    def at(word: Column, i: Column) -> Column:
        before = F.get(w, i - 1)
        return (
            F.when(word != "license", None)
            .when(before == "mit", place(i - 1, "mit"))
            .when(before == "apache", place(i - 1, "apache"))
            .when((before == "public") & (F.get(w, i - 2) == "general"), place(i - 2, "gpl"))
        )

    none = F.array().cast("array<struct<start:bigint,label:string>>")
    return F.when(F.lower(text).contains("license"), F.filter(F.transform(w, at), lambda x: x.isNotNull())).otherwise(none)


def template_grams(spark, templates=TEMPLATES, k: int = 4) -> DataFrame:
    rows = []
    for n, (label, text) in enumerate(templates):
        w = template_words(text)
        rows += [(n, label, t, len(w), len(w) - k + 1, *w[t : t + k]) for t in range(len(w) - k + 1)]
    ddl = "template int, label string, t int, size int, grams int, " + ", ".join(f"w{i} string" for i in range(k))
    return spark.createDataFrame(rows, ddl).select(F.xxhash64(*(f"w{i}" for i in range(k))).alias("gram"), "template", "label", "t", "size", "grams")


def features(docs: DataFrame, templates=TEMPLATES, how: Voting = Voting()) -> DataFrame:
    """One narrow row a row of ``docs``: key, doc_id, n_words, base hits, and (d, gram) of the k-grams that a template has."""
    spark, k = docs.sparkSession, how.k
    known = [r["gram"] for r in template_grams(spark, templates, k).select("gram").distinct().collect()]  # as many as the templates have
    gram = lambda d: F.xxhash64(*(F.get("ws", d + i) for i in range(k)))
    none = F.array().cast("array<struct<d:int,gram:bigint>>")
    places = F.filter(F.sequence(F.lit(0), F.size("ws") - k), lambda d: gram(d).isin(known))
    matched = F.when((F.size("ws") >= k) & F.lit(bool(known)), F.transform(places, lambda d: F.struct(d.alias("d"), gram(d).alias("gram")))).otherwise(none)
    ws = docs.select("doc_id", "text", words(F.col("text")).alias("ws"))
    found = ws.select("doc_id", F.size("ws").cast("long").alias("n_words"), base_places(F.col("text"), F.col("ws")).alias("hits"), matched.alias("matched"))
    return materialise(found.withColumn("key", F.monotonically_increasing_id()), "license-features")


def spans(found: DataFrame, templates=TEMPLATES, how: Voting = Voting()) -> DataFrame:
    """Verified spans of ``features``: key, label, template, first_word, last_word, cover."""
    k = how.k
    grams = found.where(F.size("matched") > 0).select("key", F.inline("matched"))
    votes = grams.join(F.broadcast(template_grams(found.sparkSession, templates, k)), "gram")
    diagonals = (
        votes.groupBy("key", "template", "label", "size", "grams", (F.col("d") - F.col("t")).alias("diagonal"))
        .agg(F.collect_set("t").alias("ts"), F.min("d").alias("low"), F.max("d").alias("high"))
    )
    order = W.partitionBy("key", "template").orderBy("diagonal")
    run = F.sum(F.when(F.col("diagonal") - F.lag("diagonal").over(order) <= how.gap, 0).otherwise(1)).over(order)
    merged = (
        diagonals.withColumn("run", run)
        .groupBy("key", "template", "label", "size", "grams", "run")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("ts")))).alias("covered"),
            F.min("low").alias("first_word"),
            (F.max("high") + k - 1).alias("last_word"),
        )
    )
    cover = F.col("covered") / F.col("grams")
    fits = (cover >= how.cover) & (F.col("last_word") - F.col("first_word") + 1 <= how.stretch * F.col("size"))
    return merged.where(fits).select("key", "label", "template", "first_word", "last_word", cover.alias("cover"))


def scan(docs: DataFrame, templates=TEMPLATES, how: Voting = Voting()) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row of ``docs``.

    ``base_labels`` are those of the base phrases, ``labels`` adds those of verified
    spans, ``score`` is the best cover of a template (0 without a span). A null
    text counts as empty: no words, no labels. Rows that repeat fare alike; other
    columns are ignored; no rows give no rows.
    """
    every = features(docs, templates, how)
    found = spans(every, templates, how).groupBy("key").agg(F.collect_set("label").alias("own"), F.max("cover").alias("cover"))
    base = every.select("key", "doc_id", "n_words", "hits", F.array_distinct("hits.label").alias("base"))
    text = lambda labels: F.array_join(F.array_sort(labels), ",")
    none = F.array().cast("array<string>")
    return base.join(found, "key", "left").select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_base"),
        F.array_min("hits.start").alias("first_word"),
        F.array_max("hits.start").alias("last_word"),
        text(F.col("base")).alias("base_labels"),
        text(F.array_union("base", F.coalesce("own", none))).alias("labels"),
        F.coalesce("cover", F.lit(0.0)).alias("score"),
    )


def sql(templates=TEMPLATES, how: Voting = Voting()) -> str:
    """The same in DuckDB over ``documents`` (distinct doc_ids)."""
    k = how.k
    rows = []
    for n, (label, text) in enumerate(templates):
        w = template_words(text)
        rows += [f"({n}, '{label}', {t}, {len(w)}, {len(w) - k + 1}, '{' '.join(w[t : t + k])}')" for t in range(len(w) - k + 1)]
    lead = " || ' ' || ".join(["w"] + [f"lead(w, {i}) OVER o" for i in range(1, k)])
    return f"""
WITH grams(template, label, t, size, grams, gram) AS (VALUES {', '.join(rows)}),
texts AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS d FROM texts),
near AS (SELECT doc_id, d, w, lag(w) OVER o AS p1, lag(w, 2) OVER o AS p2, {lead} AS gram FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY d)),
base AS (
  SELECT doc_id, CASE WHEN p1 = 'public' THEN d - 2 ELSE d - 1 END AS start, CASE p1 WHEN 'public' THEN 'gpl' ELSE p1 END AS label
  FROM near WHERE w = 'license' AND (p1 IN ('mit', 'apache') OR p1 = 'public' AND p2 = 'general')
), diagonals AS (
  SELECT doc_id, template, label, size, grams, d - t AS diagonal, list(DISTINCT t) AS ts, min(d) AS low, max(d) AS high
  FROM near JOIN grams USING (gram) GROUP BY ALL
), runs AS (
  SELECT *, sum(step) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS run FROM (
    SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {how.gap} THEN 0 ELSE 1 END AS step FROM diagonals)
), merged AS (
  SELECT doc_id, template, label, size, grams, run, len(list_distinct(flatten(list(ts)))) / grams::DOUBLE AS cover, min(low) AS first_word, max(high) + {k - 1} AS last_word
  FROM runs GROUP BY doc_id, template, label, size, grams, run
), verified AS (
  SELECT doc_id, label, cover FROM merged WHERE cover >= {how.cover} AND last_word - first_word + 1 <= {how.stretch} * size
), labelled AS (
  SELECT doc_id, label, true AS is_base, start, NULL::DOUBLE AS cover FROM base UNION ALL SELECT doc_id, label, false, NULL, cover FROM verified
)
SELECT x.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(count(start) AS BIGINT) AS n_base, CAST(min(start) AS BIGINT) AS first_word, CAST(max(start) AS BIGINT) AS last_word,
       coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE is_base)), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE label IS NOT NULL)), ','), '') AS labels,
       round(coalesce(max(cover), 0), 9) AS score
FROM texts x LEFT JOIN labelled USING (doc_id) GROUP BY x.doc_id, len(ws)
"""
