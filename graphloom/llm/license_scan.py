"""License scans by diagonal voting.

The rolling word k-gram hashes of every text are joined to the places where
templates hold them. A hit votes for the diagonal (place in the text minus
place in the template); votes are aggregated by text, template and diagonal,
as the set of template places that have one. Neighbouring diagonals are
merged, so that inserted or missing words do not break a span; a span is
verified if enough different places of the template stand within it. Hits are
compared word by word in the join, so no hash collision counts. Texts are
named by 128 bits of hash, so repeated rows are one text and a task that runs
again names its rows as before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, without
from .winnow import let

GAP = 3
AGREEMENT = 0.8
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """``exact``: counted only where all its words stand consecutively."""

    label: str
    text: str
    exact: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()


BASE = (
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
)
# The opening words of public licenses and of SPDX tags.
KNOWN = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("apache-2", "licensed under the apache license version 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license"),
    Template("cc-license", "this work is licensed under a creative commons attribution"),
    Template("spdx", "spdx license identifier"),
)


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SPLIT), lambda w: w != "")


def template_grams(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """(h, w0, w1, label, exact, at, grams): one row for each place of each template; as many as the templates have words."""
    rows = [(t.words[i], t.words[i + 1], n, t.label, t.exact, i, len(t.words) - 1) for n, t in enumerate(templates) for i in range(len(t.words) - 1)]
    table = spark.createDataFrame(rows, "w0 string, w1 string, template int, label string, exact boolean, at int, grams int")
    return table.withColumn("h", F.xxhash64(F.xxhash64("w0"), F.xxhash64("w1")))


def span_gap(grams: Column, gap: int) -> Column:
    """How far the diagonals of a span may be from its middle: a quarter of the template at most, so that its order counts."""
    return F.least(F.lit(gap), F.floor(grams / 4).cast("int"))


def scan_licenses(df: DataFrame, text: str = "text", templates: tuple[Template, ...] = BASE + KNOWN, gap: int = GAP, agreement: float = AGREEMENT) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    n_base: places of exact templates, with the smallest and largest start
    (else null). labels: those of exact templates found, and of others of
    which a span holds at least ``agreement`` of the k-grams: different ones,
    each within ``span_gap`` words of where the span's middle diagonal puts it.
    score: the greatest such share (0: none). spans: (label, start, share) of
    what was verified, the best of neighbouring ones (ties: the first), sorted.
    Null and wordless texts give zeros, nulls and empty strings.
    Input columns of these names are replaced, others of any name stay;
    repeated rows each get a row. k is 2, the length of the shortest phrase.
    """
    spark = df.sparkSession
    grams = template_grams(spark, templates)
    known = [r["h"] for r in grams.select("h").distinct().collect()]
    base = without(df, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")

    def pairs(w: Column) -> Column:
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        rolled = let(hashes, lambda h: F.zip_with(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b)))
        hits = F.filter(F.transform(rolled, lambda h, i: F.struct(i.alias("i"), h.alias("h"))), lambda p: p["h"].isin(known))
        return F.transform(hits, lambda p: F.struct(p["i"].alias("i"), p["h"].alias("h"), F.get(w, p["i"]).alias("w0"), F.get(w, p["i"] + 1).alias("w1")))

    body = F.col(f"`{text}`")
    hit = base.select(F.xxhash64(body).alias("k1"), F.xxhash64(F.lit(1), body).alias("k2"), F.explode(let(words_of(body), pairs)).alias("hit"))
    # As many rows as the templates have words, whatever the input.
    votes = hit.join(F.broadcast(grams), (F.col("hit.h") == F.col("h")) & (F.col("hit.w0") == F.col("w0")) & (F.col("hit.w1") == F.col("w1")))
    diagonals = votes.groupBy("k1", "k2", "template", "label", "exact", "grams", (F.col("hit.i") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("places"))
    # One window for each width of span; there are gap + 1 of them.
    width = F.when(F.col("exact"), 0).otherwise(span_gap(F.col("grams"), gap))
    near = lambda g: Window.partitionBy("k1", "k2", "template").orderBy("diagonal").rangeBetween(-g, g)
    found = F.coalesce(*[F.when(F.col("width") == g, F.size(F.array_distinct(F.flatten(F.collect_list("places").over(near(g)))))) for g in range(gap + 1)])
    spans = diagonals.withColumn("width", width).withColumn("found", found).withColumn("share", F.col("found") / F.col("grams"))
    rank = F.struct(F.col("found"), (-F.col("diagonal")).alias("d"))
    best = F.coalesce(*[F.when(F.col("width") == g, F.max(rank).over(near(g))) for g in range(gap + 1)])
    good = spans.withColumn("best", rank == best).where(F.when(F.col("exact"), F.col("found") == F.col("grams")).otherwise(F.col("share") >= agreement))
    per_text = good.groupBy("k1", "k2").agg(
        F.count(F.when(F.col("exact"), 1)).alias("n_base"), F.min(F.when(F.col("exact"), F.col("diagonal"))).cast("long").alias("first_word"), F.max(F.when(F.col("exact"), F.col("diagonal"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("label")))), ",").alias("base_labels"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"), F.array_sort(F.collect_list(F.when(F.col("best"), F.struct("label", F.col("diagonal").alias("start"), "share")))).alias("spans"))
    columns = [f"c{i}" for i in range(len(base.columns))]
    keyed = base.select(F.size(words_of(body)).cast("long"), F.xxhash64(body), F.xxhash64(F.lit(1), body), *[F.col(f"`{c}`") for c in base.columns]).toDF("n_words", "k1", "k2", *columns)
    joined = keyed.join(per_text, ["k1", "k2"], "left")
    return joined.select(
        *[F.col(p).alias(c) for p, c in zip(columns, base.columns, strict=True)], "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), "spans")


_VALUES = ", ".join(f"({n}, '{t.label}', {str(t.exact).lower()}, '{t.text}')" for n, t in enumerate(BASE + KNOWN))
ORACLE_OP6 = rf"""
WITH templates(template, label, exact, words) AS (SELECT column0, column1, column2, string_split(column3, ' ') FROM (VALUES {_VALUES}) v(column0, column1, column2, column3)),
grams AS (SELECT template, label, exact, len(words) - 1 AS grams, i - 1 AS place, words[i] AS w0, words[i + 1] AS w1 FROM (SELECT *, unnest(range(1, len(words))) AS i FROM templates)),
d AS (SELECT row_number() OVER () AS k, doc_id,
  list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT k, unnest(w[:-2]) AS w0, unnest(w[2:]) AS w1, unnest(range(len(w) - 1)) AS i FROM d WHERE len(w) > 1),
diagonals AS (SELECT DISTINCT k, template, label, exact, grams, place, i - place AS diagonal FROM p JOIN grams USING (w0, w1)),
spans AS (SELECT x.k, x.template, x.label, x.exact, x.grams, x.diagonal AS start, count(DISTINCT y.place) AS votes
  FROM (SELECT DISTINCT k, template, label, exact, grams, diagonal FROM diagonals) x
  JOIN diagonals y ON x.k = y.k AND x.template = y.template AND abs(x.diagonal - y.diagonal) <= CASE WHEN x.exact THEN 0 ELSE least({GAP}, x.grams // 4) END GROUP BY ALL),
good AS (SELECT *, votes / grams AS share FROM spans WHERE CASE WHEN exact THEN votes = grams ELSE votes / grams >= {AGREEMENT} END),
r AS (SELECT k, count(*) FILTER (WHERE exact) AS n_base, min(start) FILTER (WHERE exact) AS first_word, max(start) FILTER (WHERE exact) AS last_word,
  coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE exact)), ','), '') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(share) AS score FROM good GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN r USING (k)
"""
