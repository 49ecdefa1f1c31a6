"""License scans by diagonal voting.

Hashes of all rolling word pairs of each text meet, in one join, the places where license templates have them; the words
behind a hash are compared there and then. Hits on one diagonal (place in the text less place in the template) vote for
the template starting there. A short phrase stands where its diagonal has all of its pairs. A long notice is looked for
on bands of neighbouring diagonals, of a fixed width, which allow for words put in or left out; what counts of a band is the
longest chain of pairs in the order of both the text and the template, which must cover enough of the notice. Everything is DataFrame functions; texts stay in their row, only hits travel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose consecutive words are counted, with their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Opening words of public license notices, with their labels.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this work is licensed under the creative commons attribution", "cc-by"),
    ("all rights reserved", "proprietary"),
    ("released into the public domain", "public-domain"),
)
#: Diagonals of a band: the first and so many after it.
BAND = 3
#: Share of a notice's pairs that a band must have in order.
COVERED = 0.8
#: Template that every text meets once, at its end: it keeps texts without hits, and their numbers of words.
EVERY = -1


def templates(phrases=PHRASES, notices=NOTICES) -> list[tuple[int, bool, str, int, int, str, str]]:
    """(template, is a phrase, label, pairs, place, word, next word) of every word pair of the templates."""
    rows = []
    for t, (text, label) in enumerate([*phrases, *notices]):
        w = text.split()
        rows += [(t, t < len(phrases), label, len(w) - 1, i, w[i], w[i + 1]) for i in range(len(w) - 1)]
    return rows


def in_order(hits: Column) -> Column:
    """Longest chain of (pos, tpos) hits in which both rise; hits are an array in order of pos, then falling tpos."""

    def longer(chains, h):
        before = F.array_max(F.transform(F.filter(chains, lambda c: c["tpos"] < h["tpos"]), lambda c: c["n"]))
        return F.array_append(chains, F.struct(h["tpos"].alias("tpos"), (F.coalesce(before, F.lit(0)) + 1).alias("n")))

    none = F.array().cast("array<struct<tpos:int,n:int>>")
    return F.aggregate(hits, none, longer, lambda chains: F.coalesce(F.array_max(F.transform(chains, lambda c: c["n"])), F.lit(0)))


def license_hits(docs: DataFrame, phrases=PHRASES, notices=NOTICES, id_col="doc_id", text_col="text") -> DataFrame:
    """(row, doc_id, template, phrase, label, pairs, tpos, pos) of all word pairs that templates have, row by row; and of
    each row one of template EVERY, whose pos is the number of words. row is a number of the row's own, fixed by staging."""
    spark = docs.sparkSession
    place = spark.createDataFrame(templates(phrases, notices), "template int, phrase boolean, label string, pairs int, tpos int, w1 string, w2 string")
    end = spark.createDataFrame([(EVERY,)], "template int")
    place = place.withColumn("gram", F.xxhash64("w1", "w2")).unionByName(end.withColumn("gram", F.lit(EVERY).cast("long")), allowMissingColumns=True)
    words = F.regexp_extract_all(C.lower_ascii(F.coalesce(docs[text_col], F.lit(""))), F.lit(WORDS), F.lit(0))
    texts = docs.select(docs[id_col].alias("doc_id"), words.alias("words"), F.monotonically_increasing_id().alias("row"))
    grams = F.concat(F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1))), F.array(F.lit(EVERY).cast("long")))
    rolled = texts.select("row", "doc_id", "words", F.posexplode(grams).alias("pos", "gram"))
    same = (F.col("template") == EVERY) | ((F.get("words", F.col("pos")) == F.col("w1")) & (F.get("words", F.col("pos") + 1) == F.col("w2")))
    met = rolled.join(F.broadcast(place), "gram").where(same)  # the templates are fixed and small
    return C.staged(met.select("row", "doc_id", "template", "phrase", "label", "pairs", "tpos", "pos"), "hits")


def license_spans(docs: DataFrame, phrases=PHRASES, notices=NOTICES, id_col="doc_id", text_col="text") -> tuple[DataFrame, DataFrame]:
    """(texts, spans): texts has row (a number of its own), doc_id, n_words; spans has one row a verified span, whole or in part.

    Spans: row, template, phrase, label, pairs, matched (pairs in order), first and last (words of the text from 0), score
    (matched / pairs). Of bands that overlap with the same template the best is kept, of equal ones the first. Null and
    empty texts have no words; repeated rows have spans each; other columns are not read.
    """
    met = license_hits(docs, phrases, notices, id_col, text_col)
    texts = met.where(F.col("template") == EVERY).select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))
    hits = met.where(F.col("template") != EVERY).withColumn("diagonal", F.col("pos") - F.col("tpos"))
    keys = ["row", "template", "phrase", "label", "pairs"]
    # A place of a template is hit once on a diagonal at most. Phrases take whole diagonals.
    exact = hits.where("phrase").groupBy(*keys, "diagonal").agg(F.count(F.lit(1)).cast("int").alias("matched")).where("matched = pairs")
    exact = exact.select(*keys, "matched", F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("pairs")).alias("last"))
    votes = hits.where("not phrase").groupBy(*keys, "diagonal").agg(F.collect_list(F.struct("pos", "tpos")).alias("votes"))
    near = Window.partitionBy("row", "template").orderBy("diagonal")
    # A band has at most pairs * (BAND + 1) hits.
    band = F.flatten(F.collect_list("votes").over(near.rangeBetween(0, BAND)))
    bands = votes.select(*keys, "diagonal", band.alias("band"))
    ordered = F.transform(F.array_sort(F.transform("band", lambda h: F.struct(h["pos"].alias("pos"), (-h["tpos"]).alias("back")))), lambda h: F.struct(h["pos"].alias("pos"), (-h["back"]).alias("tpos")))
    found = bands.select(*keys, "diagonal", in_order(ordered).alias("matched"), F.array_min("band")["pos"].alias("first"), (F.array_max("band")["pos"] + 1).alias("last"))
    mine = F.struct("matched", (-F.col("diagonal")).alias("back"))
    notice = found.withColumn("best", F.max(mine).over(near.rangeBetween(-BAND, BAND))).where(mine == F.col("best"))
    spans = exact.unionByName(notice.drop("diagonal", "best")).withColumn("score", F.col("matched") / F.col("pairs"))
    return texts, spans


def license_labels(docs: DataFrame, phrases=PHRASES, notices=NOTICES, covered: float = COVERED, id_col="doc_id", text_col="text") -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    base columns come from whole phrases, labels also from notices of which a band has ``covered`` or more of the pairs in
    order; score is the largest such share of a template, 0 without any. Null and empty texts have no words and no label;
    repeated rows and null ids are rows like others; labels are sorted, so that ties between templates don't show; an
    empty table gives an empty result.
    """
    texts, spans = license_spans(docs, phrases, notices, id_col, text_col)
    base, good = F.col("phrase"), F.col("phrase") | (F.col("score") >= covered)

    def joined(which):
        return F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")

    per = spans.groupBy("row").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(good).alias("labels"), F.max("score").alias("score"),
    )
    none = {"n_base": 0, "base_labels": "", "labels": "", "score": 0.0}
    return texts.join(per, "row", "left").select("doc_id", "n_words", *per.columns[1:]).fillna(none)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """license_labels of all documents."""
    return license_labels(C.table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same by other means: phrases by lists of words, notices by chains of pairs grown step by step."""
    rows = ", ".join(f"({t}, {p}, '{lab}', {n}, {i}, '{a}', '{b}')" for t, p, lab, n, i, a, b in templates())
    phrases = ", ".join(f"('{lab}', {text.split()!r})" for text, lab in PHRASES)
    return rf"""
WITH RECURSIVE place(template, phrase, label, pairs, tpos, w1, w2) AS (VALUES {rows}),
phrases(label, p) AS (VALUES {phrases}),
texts AS (SELECT row_number() OVER () AS k, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), '{C.UPPER}', '{C.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
grams AS (SELECT k, pos - 1 AS pos, w[pos] AS w1, w[pos + 1] AS w2, w FROM (SELECT k, w, unnest(range(1, len(w))) AS pos FROM texts)),
base AS (SELECT k, label, pos AS start FROM grams JOIN phrases ON w1 = p[1] AND w2 = p[2] AND w[pos + 1 : pos + len(p)] = p),
hits AS (SELECT k, template, label, pairs, pos, tpos, pos - tpos AS diagonal FROM grams JOIN place USING (w1, w2) WHERE NOT phrase),
starts AS (SELECT DISTINCT k, template, diagonal AS d FROM hits),
band AS (SELECT k, template, d, label, pairs, pos, tpos FROM starts JOIN hits USING (k, template) WHERE diagonal BETWEEN d AND d + {BAND}),
chain AS (SELECT k, template, d, label, pairs, pos, tpos, 1 AS n FROM band
  UNION SELECT c.k, c.template, c.d, c.label, c.pairs, x.pos, x.tpos, n + 1 FROM chain c JOIN band x ON c.k = x.k AND c.template = x.template AND c.d = x.d AND x.pos > c.pos AND x.tpos > c.tpos),
notices AS (SELECT k, label, max(n)::DOUBLE / pairs AS score FROM chain GROUP BY k, template, d, label, pairs),
spans AS (SELECT k, true AS phrase, label, start, 1.0::DOUBLE AS score FROM base UNION ALL SELECT k, false, label, 0, score FROM notices),
per AS (SELECT k, count(*) FILTER (phrase) AS n_base, min(start) FILTER (phrase) AS first_word, max(start) FILTER (phrase) AS last_word,
  array_to_string(list_sort(list(DISTINCT label) FILTER (phrase)), ',') AS base_labels,
  array_to_string(list_sort(list(DISTINCT label) FILTER (phrase OR score >= {COVERED})), ',') AS labels, max(score) AS score FROM spans GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM texts LEFT JOIN per USING (k)"""


QUERIES = {"op8_license_scan": op8_license_scan}
ORACLES = {"op8_license_scan": oracle()}
