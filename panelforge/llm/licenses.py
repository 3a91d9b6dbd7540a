"""License scan by diagonal voting over rolling word k-grams.

Each template (a notice, or a phrase that names a license) is cut into all its word k-grams with their
places. The rolling k-gram hashes of every document join the template hashes; a match at document place p
and template place t votes for the diagonal p - t. A diagonal's votes are the distinct template places found on
it. Neighbouring diagonals of a notice (a word more or less in between) are merged into a span, and each span is
verified: a template place counts once, and only if it stands in the document after the place before it. A
span counts if enough of its template's k-grams are left. Matching k-grams are compared word by word at the
join, so no hash collision gets through. DataFrame functions only; the template table is a fixed, small set.
Before hashing, k-grams whose first or last word no template has are left out: they can't match.

Phrases use k = 2 and must be matched whole on one diagonal: those are the base places and labels. Notices
use k = 4; a span with at least ``coverage`` of the notice's k-grams adds the notice's label.

Edge cases: null and empty texts have no words, no places and empty labels; every row is a document of its own,
also where rows repeat a doc_id or have none; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.llm.common import alnum_words, table

# The phrases of the base labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# Public license notices, as words, and the label of each.
NOTICES = [
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing "
        "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
        "apache",
    ),
    ("licensed under the apache license version 2 0", "apache"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
        "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability "
        "whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "mit",
    ),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("released under the mit license", "mit"),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by "
        "the free software foundation either version 3 of the license or at your option any later version "
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
        "merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "gpl",
    ),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
        "in the documentation and or other materials provided with the distribution",
        "bsd",
    ),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file "
        "you can obtain one at http mozilla org mpl 2 0",
        "mpl",
    ),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies",
        "isc",
    ),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under cc by 4 0", "cc-by"),
]

PHRASE_K, NOTICE_K = 2, 4


def template_grams(spark: SparkSession, phrases: list, notices: list) -> DataFrame:
    """template, label, is_phrase, grams (how many it has), t (place), gram (words), h (hash)."""
    rows = []
    for number, (text, label, k) in enumerate([(*p, PHRASE_K) for p in phrases] + [(*n, NOTICE_K) for n in notices]):
        w = text.split()
        rows += [(number, label, k == PHRASE_K, len(w) - k + 1, t, w[t : t + k]) for t in range(len(w) - k + 1)]
    grams = spark.createDataFrame(rows, "template int, label string, is_phrase boolean, grams int, t int, gram array<string>")
    return grams.withColumn("h", F.when(F.col("is_phrase"), _hash("gram", PHRASE_K)(F.lit(0))).otherwise(_hash("gram", NOTICE_K)(F.lit(0))))


def _hash(words: str, k: int):
    return lambda i: F.xxhash64(*(F.get(F.col(words), i + j) for j in range(k)))


def votes(docs: DataFrame, phrases: list, notices: list) -> DataFrame:
    """Matches (row, doc_id, template, label, is_phrase, grams, p, t), and for each row a match without template that has n_words."""
    spark = docs.sparkSession
    grams = template_grams(spark, phrases, notices)
    none = {"template": "int", "label": "string", "is_phrase": "boolean", "grams": "int", "t": "int", "gram": "array<string>"}
    document = spark.range(1).select(*(F.lit(None).cast(t).alias(c) for c, t in none.items()), F.lit(0).cast("long").alias("h"))
    grams = F.broadcast(grams.unionByName(document))

    words = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", alnum_words(F.col("text")).alias("w")).withColumn("size", F.size("w"))

    def rolling(k: int, templates: list):
        firsts, lasts = ({w for t, _ in templates for w in (t.split()[: 1 - k] if first else t.split()[k - 1 :])} for first in (True, False))
        places = F.sequence(F.lit(0), F.col("size") - k)
        able = F.filter(places, lambda i: F.get(F.col("w"), i).isin(*sorted(firsts)) & F.get(F.col("w"), i + (k - 1)).isin(*sorted(lasts)))
        return F.when(F.col("size") >= k, F.transform(able, lambda i: F.struct(i.alias("p"), F.lit(k).alias("k"), _hash("w", k)(i).alias("h")))).otherwise(F.array().cast("array<struct<p:int,k:int,h:bigint>>"))

    marker = F.array(F.struct(F.lit(-1).alias("p"), F.lit(0).alias("k"), F.lit(0).cast("long").alias("h")))
    rolled = words.select("row", "doc_id", "size", "w", F.explode(F.concat(rolling(PHRASE_K, phrases), rolling(NOTICE_K, notices), marker)).alias("g"))
    rolled = rolled.select("row", "doc_id", "size", "w", "g.p", "g.k", "g.h")
    same = (F.col("p") < 0) & F.col("gram").isNull() | (F.col("p") >= 0) & (F.slice("w", F.greatest(F.col("p"), F.lit(0)) + 1, F.col("k")) == F.col("gram"))
    found = rolled.join(grams, "h").filter(same)
    return found.select("row", "doc_id", "template", "label", "is_phrase", "grams", "p", "t", F.when(F.col("p") < 0, F.col("size")).alias("n_words"))


def scan_licenses(docs: DataFrame, phrases: list = PHRASES, notices: list = NOTICES, coverage: float = 0.7, merge: int = 3) -> DataFrame:
    """One row per row of docs: the places of whole phrases, their labels, the labels with notices, and the best span's share."""
    # Only matches are left here; all that follows shares this one partitioning.
    found = votes(docs, phrases, notices).withColumn("diagonal", F.col("p") - F.col("t")).repartition("row")
    of = ["row", "doc_id", "template", "label", "is_phrase", "grams"]
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(order)
    new = F.coalesce(F.when(F.col("is_phrase"), step > 0).otherwise(step > merge), F.lit(True))
    spans = found.withColumn("new", new.cast("int")).withColumn("span", F.sum("new").over(order))
    # Verification: a template place counts once, at its first place in the span, if that lies after the one before.
    places = spans.groupBy(*of, "span", "t").agg(F.min("p").alias("p"), F.min("diagonal").alias("start"), F.max("n_words").alias("n_words"))
    places = places.groupBy(*of, "span").agg(F.array_sort(F.collect_list(F.when(F.col("p") >= 0, F.struct("t", "p")))).alias("at"), F.min("start").alias("start"), F.max("n_words").alias("n_words"))
    in_order = F.size(F.filter(F.sequence(F.lit(0), F.size("at") - 1), lambda i: (i == 0) | (F.get(F.col("at"), i)["p"] > F.get(F.col("at"), i - 1)["p"])))
    spans = places.withColumn("votes", F.when(F.size("at") > 0, in_order).otherwise(0))
    share = F.col("votes") / F.col("grams")
    base = F.col("is_phrase") & (F.col("votes") == F.col("grams"))
    named = base | (~F.col("is_phrase") & (share >= coverage))

    def labels(when):
        return F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")

    return spans.groupBy("row", "doc_id").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(named).alias("labels"),
        F.coalesce(F.max(F.when(named, share)), F.lit(0.0)).alias("score"),
    ).drop("row")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    words = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    values = ", ".join(f"({n}, '{label}', {phrase}, {k}, string_split('{text}', ' '))" for n, (text, label, phrase, k) in enumerate([(*p, True, PHRASE_K) for p in PHRASES] + [(*p, False, NOTICE_K) for p in NOTICES]))
    return f"""
WITH words AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
templates AS (SELECT * FROM (VALUES {values}) AS v(template, label, is_phrase, k, tw)),
tgrams AS (SELECT template, label, is_phrase, k, len(tw) - k + 1 AS grams, t - 1 AS t, tw[t:t + k - 1] AS gram FROM templates, unnest(range(1, len(tw) - k + 2)) AS u(t)),
dgrams AS (SELECT r, k, p - 1 AS p, w[p:p + k - 1] AS gram FROM words, (SELECT DISTINCT k FROM templates), unnest(range(1, greatest(len(w) - k + 2, 1))) AS u(p)),
matches AS (SELECT r, template, label, is_phrase, grams, p, t, p - t AS diagonal FROM dgrams JOIN tgrams USING (k, gram)),
diagonals AS (SELECT DISTINCT r, template, is_phrase, diagonal FROM matches),
numbered AS (SELECT *, sum(CASE WHEN is_phrase OR before IS NULL OR diagonal - before > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY r, template ORDER BY diagonal) AS span
             FROM (SELECT *, lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) AS before FROM diagonals)),
firsts AS (SELECT r, template, label, is_phrase, grams, span, t, min(p) AS p, min(diagonal) AS diagonal FROM matches JOIN numbered USING (r, template, is_phrase, diagonal) GROUP BY ALL),
ordered AS (SELECT *, coalesce(p > lag(p) OVER (PARTITION BY r, template, span ORDER BY t), true) AS fits FROM firsts),
spans AS (SELECT r, template, label, is_phrase, grams, span, count(*) FILTER (fits) AS votes, min(diagonal) AS start FROM ordered GROUP BY ALL),
judged AS (SELECT *, votes / grams AS share, is_phrase AND votes = grams AS base, (is_phrase AND votes = grams) OR (NOT is_phrase AND votes / grams >= 0.7) AS named FROM spans)
SELECT w.doc_id, CAST(len(any_value(w.w)) AS BIGINT) AS n_words, count(*) FILTER (base) AS n_base,
       CAST(min(start) FILTER (base) AS BIGINT) AS first_word, CAST(max(start) FILTER (base) AS BIGINT) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (named), '') AS labels,
       CAST(coalesce(max(share) FILTER (named), 0) AS DOUBLE) AS score
FROM words w LEFT JOIN judged j ON w.r = j.r GROUP BY w.r, w.doc_id
"""


ORACLE = _oracle()
