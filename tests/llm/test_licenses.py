from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tallycast.llm import licenses

PHRASES = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}
FREE = licenses.TEMPLATES[-3][1]


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = sorted((i, label) for label, p in PHRASES.items() for i in range(len(w)) if w[i:i + len(p)] == p)
    starts = [i for i, _ in places]
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))


def answer(spark, rows, schema="doc_id long, text string"):
    return licenses.report(spark.createDataFrame(rows, schema)).collect()


def test_base_places_equal_brute_force(spark):
    rng = random.Random(2)
    vocabulary = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "CC", "By-", "x", "the", "Ärights", "K"]
    rows = [(i, rng.choice([" ", "-", ". "]).join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(200)]
    rows += [(900, None), (901, ""), (902, "cc"), (903, "by cc by"), (None, "All rights reserved"), (2**60 + 1, "cc by cc by"), (904, "CC BY " * 30_000), (903, "by cc by"), (903, "cc by")]
    got = sorted((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in answer(spark, rows)), sorted((str(i), *brute(t)) for i, t in rows)
    assert sorted(map(str, got[0])) == sorted(map(str, got[1]))
    for r in answer(spark, rows):
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert r.score == 1 or not r.base_labels


@pytest.mark.parametrize("name, text, labels", [
    ("whole", FREE, "mit"),
    ("within", f"some code {FREE} and more", "mit"),
    ("word added", FREE.replace("obtaining", "ever obtaining"), "mit"),
    ("words left out", FREE.replace("of charge ", "").replace("software and", "and"), "mit"),
    ("word replaced", FREE.replace("person", "body"), "mit"),
    ("twice in a row", f"{FREE} {FREE}", "mit"),
    ("a third of it", " ".join(FREE.split()[:7]), ""),
    ("spread out", " filler words here and there ".join(FREE.split()), ""),
    ("short line", "Licensed under the Apache License, Version 2.0.", "apache"),
    ("unrelated", "a licence to fish is under the table", ""),
])
def test_spans_of_templates(spark, name, text, labels):
    row = answer(spark, [(1, text.upper())])[0]
    assert row.labels == labels
    assert (row.score >= licenses.COVERED) == bool(labels)


def test_spans_have_places(spark):
    docs = spark.createDataFrame([(1, f"one two three {FREE} after")], "doc_id long, text string")
    _, found = licenses.scan(docs)
    r = found.where("verified").collect()
    assert [(x.label, x.start, x.end, x.coverage) for x in r] == [("mit", 3, 3 + len(FREE.split()), 1.0)]


def test_own_templates(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha beta"), (3, "beta gamma")], "doc_id long, text string")
    _, found = licenses.scan(docs, [("ab", "alpha beta")], [("all", "alpha beta gamma delta")])
    assert {(r.doc_id, r.label) for r in found.where("verified").collect()} >= {(1, "ab"), (2, "ab")}


def test_empty_table_and_clashing_columns(spark):
    schema = "doc_id long, text string, h long, t int, label string, w string"
    assert answer(spark, [(1, "All rights reserved.", 1, 2, "a", "b")], schema)[0].base_labels == "reserved"
    df = spark.createDataFrame([], schema)
    assert licenses.report(df).count() == 0
    assert licenses.report(df).schema == licenses.report(df.where(F.lit(True))).schema


def test_places_are_joined_by_number_before_gram_texts_are_made(spark):
    """A word costs a look-up of a hash: no copies of the word array, and texts are joined where a hash was found only."""
    docs = spark.createDataFrame([(1, FREE)], "doc_id long, text string")
    table = licenses.template_table(spark, licenses.BASE, licenses.TEMPLATES)
    plan = licenses.hits(docs, table, ["cc by"])._jdf.queryExecution().executedPlan().toString()
    assert "arrays_zip" not in plan and "slice(" not in plan
    assert re.search(r"BroadcastHashJoin \[hash#\d+L\], \[hash#\d+L\], LeftSemi", plan)
    assert re.search(r"BroadcastHashJoin \[said#\d+\], \[said#\d+\], Inner", plan)


def test_gram_texts_decide_where_hashes_clash(spark, monkeypatch):
    """With one hash for all grams, every place passes the first join and the second one alone decides."""
    monkeypatch.setattr(licenses.F, "xxhash64", lambda *_: F.lit(7).cast("long"))
    rows = [(1, f"x {FREE} y all rights reserved"), (2, "CC by cc"), (3, ""), (4, None), (5, "rights reserved all")]
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in answer(spark, rows)} == {i: brute(t) for i, t in rows}


def test_words_beyond_ascii_keep_their_case(spark):
    """Every character there is, alone and between letters: the quick way to lower-case is taken for ASCII only."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(points[i:i + 500]) for i in range(0, len(points), 500)] + [f"A{c}B" for c in points[:0x600]]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = {r.i: r.w for r in df.select("i", licenses.words(F.col("text")).alias("w")).collect()}
    for i, text in enumerate(texts):
        assert got[i] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
