"""License scan by diagonal voting, in DataFrame functions only.

Texts and license templates are runs of words. Where a text repeats part of a template, its words stand at one
distance from the template's: on one diagonal (place in the text less place in the template).

1. One pass hashes the rolling grams of all texts, `GRAM` words from each place on (the two words of a template that
   has only two, wherever they stand), and joins them to the places of the templates' grams. The templates are a
   fixed list, so their grams are few and broadcast. Gram texts are compared after the hashes. What is found is
   written once: a row a document and a row a hit.
2. Hits vote for their diagonal, by aggregation per (text, template, diagonal).
3. Diagonals of a template that lie within `SLACK` words merge: words were added or left out between their hits.
4. A span is verified by the template's words that its hits confirm, `COVERED` of them at least, and its length. A
   base phrase must stand whole on one diagonal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallycast.llm.common import whole_text, written
from tallycast.llm.decontaminate import WORDS_SQL, words

# The base phrases and their labels.
BASE = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]
# Customary wording of public licenses and notices, with a label of our own for each.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
GRAM, SLACK, COVERED = 3, 3, 0.7


def template_table(spark: SparkSession, base: list[tuple[str, str]], templates: list[tuple[str, str]]) -> DataFrame:
    """(t, label, base, w): base phrases first."""
    rows = [F.struct(F.lit(i).alias("t"), F.lit(label).alias("label"), F.lit(i < len(base)).alias("base"), F.lit(text).alias("text"))
            for i, (label, text) in enumerate([*base, *templates])]
    return spark.range(1).select(F.inline(F.array(*rows))).select("t", "label", "base", words(F.col("text")).alias("w"))


def gram_places(df: DataFrame, pairs: list[str], marked: bool) -> DataFrame:
    """A row for each gram of the word array `w`: pos, hash, said, k beside the other columns. A gram is the two
    words of `pairs` where they stand, else `GRAM` words. With `marked`, a row at place -1 for each row of `df`, with
    an empty gram."""
    others = [c for c in df.columns if c != "w"]
    firsts = F.concat(F.array(F.lit("")), "w") if marked else F.col("w")
    at = df.select(*others, "w", F.posexplode(firsts).alias("at", "first")).withColumn("pos", F.col("at") - int(marked))
    # further words are read from the text's array, so that no place needs a copy of them; they are null past the end
    further = [F.get("w", F.col("pos") + i) for i in range(1, GRAM)]
    short = F.lit(False)
    for pair in pairs:
        first, second = pair.split(" ")
        short = short | ((F.col("first") == first) & (further[0] == second))
    k = F.when(F.col("pos") < 0, 1).when(short, 2).otherwise(GRAM)
    # nulls are left out of hashes and joined texts
    said = [F.col("first"), *(F.when(k > i, word) for i, word in enumerate(further, 1))]
    return at.select(*others, "pos", F.xxhash64(*said).alias("hash"), F.concat_ws(" ", *said).alias("said"), k.alias("k"))


def hits(docs: DataFrame, table: DataFrame, pairs: list[str]) -> DataFrame:
    """(doc_id, h, n_words, pos, t, off, k): a row with t = -1 for each document, and a row for each gram of a text
    that stands in a template. `h` tells the texts of one id apart."""
    grams = gram_places(table.select("t", "w", F.size("w").alias("n")), pairs, False).where(F.col("pos") + F.col("k") <= F.col("n"))
    marker = table.sparkSession.range(1).select(F.xxhash64(F.lit("")).alias("hash"), F.lit("").alias("said"), F.lit(-1).alias("t"), F.lit(-1).alias("off"))
    grams = grams.select("hash", "said", "t", F.col("pos").alias("off")).unionByName(marker)
    texts = docs.select("doc_id", whole_text().alias("text")).select("doc_id", F.xxhash64("text").alias("h"), words(F.col("text")).alias("w"))
    places = gram_places(texts.withColumn("n_words", F.size("w").cast("long")), pairs, True)
    # a join by the hash alone looks up a number a word; gram texts are made and joined for the few rows that it leaves
    likely = places.join(F.broadcast(grams.select("hash")), "hash", "left_semi")
    found = likely.join(F.broadcast(grams.drop("hash")), "said")
    return found.select("doc_id", "h", "n_words", F.col("pos").cast("long").alias("pos"), "t", "off", "k")


def spans(found: DataFrame, table: DataFrame) -> DataFrame:
    """(doc_id, h, t, label, base, start, end, coverage, verified) of merged diagonals; `end` is exclusive."""
    place = ["doc_id", "h", "t"]
    at = found.where("t >= 0").withColumn("diagonal", F.col("pos") - F.col("off"))
    votes = at.groupBy(*place, "diagonal").agg(F.count("*").alias("votes"))
    before = F.lag("diagonal").over(W.partitionBy(*place).orderBy("diagonal"))
    lengths = F.broadcast(table.select("t", "label", "base", F.size("w").alias("n")))  # a row for each template
    parted = votes.join(lengths, "t").withColumn("apart", F.coalesce(F.col("base") | (F.col("diagonal") - before > SLACK), F.lit(True)).cast("int"))
    merged = parted.withColumn("span", F.sum("apart").over(W.partitionBy(*place).orderBy("diagonal").rowsBetween(W.unboundedPreceding, 0)))
    key = F.struct(*place, "diagonal")
    held = at.select("*", key.alias("key")).join(merged.select(key.alias("key"), "label", "base", "n", "span"), "key")
    word = F.explode(F.sequence(F.col("off"), F.col("off") + F.col("k") - 1)).alias("word")
    confirmed = held.select(*place, "label", "base", "n", "span", "pos", (F.col("pos") + F.col("k")).alias("stop"), word)
    by = [*place, "label", "base", "n", "span"]
    covered = confirmed.groupBy(*by, "word").agg(F.min("pos").alias("start"), F.max("stop").alias("end"))
    out = covered.groupBy(*by).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("words"))
    coverage = F.col("words") / F.col("n")
    whole = F.when(F.col("base"), F.col("words") == F.col("n")).otherwise((coverage >= COVERED) & (F.col("end") - F.col("start") <= 1.5 * F.col("n") + SLACK))
    return out.select(*place, "label", "base", "start", "end", coverage.alias("coverage"), whole.alias("verified"))


def scan(docs: DataFrame, base: list[tuple[str, str]] | None = None, templates: list[tuple[str, str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, h, n_words), a row for each row of `docs`, and `spans` of each different (doc_id, text).

    Null texts have no words; a null doc_id is an id like others; columns beside doc_id and text are ignored; an empty
    table gives empty tables. Rows of one id and text share their spans. A template needs two words or more."""
    base, templates = BASE if base is None else base, TEMPLATES if templates is None else templates
    pairs = [text for _, text in [*base, *templates] if text.count(" ") == 1]
    table = template_table(docs.sparkSession, base, templates)
    found = written(hits(docs, table, pairs), "licenses")
    return found.where("t = -1").select("doc_id", "h", "n_words"), spans(found, table)


def listed(names: Column) -> Column:
    return F.array_join(F.sort_array(F.collect_set(names)), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; the score is the largest share of
    a template that a span covers, verified or not."""
    texts, found = scan(docs)
    place, is_base = F.col("verified") & F.col("base"), F.struct("doc_id", "h").alias("key")
    own = found.groupBy("doc_id", "h").agg(
        F.count_if(place).alias("n_base"), F.min(F.when(place, F.col("start"))).alias("first_word"), F.max(F.when(place, F.col("start"))).alias("last_word"),
        listed(F.when(place, F.col("label"))).alias("base_labels"), listed(F.when(F.col("verified"), F.col("label"))).alias("labels"), F.max("coverage").alias("score"))
    joined = texts.select("*", is_base).join(own.select(is_base, *own.columns[2:]), "key", "left")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def _sql() -> str:
    """The definition in DuckDB: every template place against every text place, then diagonals."""
    rows = ", ".join(f"({i}, '{label}', {str(i < len(BASE)).lower()}, string_split('{text}', ' '))" for i, (label, text) in enumerate([*BASE, *TEMPLATES]))
    gram = "CASE WHEN w[p] = 'cc' AND w[p + 1] = 'by' THEN array_to_string(w[p : p + 1], ' ') ELSE array_to_string(w[p : p + 2], ' ') END"
    size = "CASE WHEN w[p] = 'cc' AND w[p + 1] = 'by' THEN 2 ELSE 3 END"
    return f"""
WITH t AS (SELECT * FROM (VALUES {rows}) AS x(t, label, base, w)),
tg AS (SELECT t, label, base, n, p - 1 AS off, k, g FROM (SELECT t, label, base, len(w) AS n, p, {size} AS k, {gram} AS g FROM (SELECT *, unnest(range(1, len(w) + 1)) AS p FROM t)) WHERE p - 1 + k <= n),
d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL} AS w FROM documents),
dg AS (SELECT r, p - 1 AS pos, {size} AS k, {gram} AS g FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
hit AS (SELECT r, t, label, base, n, pos, off, dg.k, pos - off AS diagonal FROM dg JOIN tg USING (g)),
votes AS (SELECT DISTINCT r, t, base, diagonal FROM hit),
cut AS (SELECT *, CASE WHEN base OR coalesce(diagonal - lag(diagonal) OVER (PARTITION BY r, t ORDER BY diagonal) > {SLACK}, true) THEN 1 ELSE 0 END AS apart FROM votes),
merged AS (SELECT r, t, diagonal, sum(apart) OVER (PARTITION BY r, t ORDER BY diagonal) AS span FROM cut),
held AS (SELECT hit.*, span, unnest(range(off, off + k)) AS word FROM hit JOIN merged USING (r, t, diagonal)),
spans AS (SELECT r, t, label, base, n, span, min(pos) AS a, max(pos + k) AS b, count(DISTINCT word) AS words FROM held GROUP BY ALL),
found AS (SELECT r, label, base, a, words / n AS coverage, CASE WHEN base THEN words = n ELSE words / n >= {COVERED} AND b - a <= 1.5 * n + {SLACK} END AS ok FROM spans),
own AS (SELECT r, count(*) FILTER (ok AND base) AS n_base, min(a) FILTER (ok AND base) AS first_word, max(a) FILTER (ok AND base) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (ok AND base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (ok) AS labels, max(coverage) AS score FROM found GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score FROM d LEFT JOIN own USING (r)"""


SQL = _sql()
