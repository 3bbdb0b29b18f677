from __future__ import annotations

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tallycast.llm import decontaminate as dc


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    wins = {}
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[i:i + 10]), set()).add(item)
    out = {}
    for doc, text in docs:
        w, hit, found = words_of(text), set(), set()
        for win, ids in wins.items():
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p:p + len(win)]) == win:
                    hit |= set(range(p, p + len(win)))
                    found |= ids
        ids = ",".join(sorted(str(x) for x in found if x is not None))
        out[doc] = (len(w), len(hit), len(found - {None}), hashlib.sha256(ids.encode()).hexdigest(), bool(hit))
    return out


def rows_of(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}


@pytest.mark.parametrize("limit", [0, 500_000])
def test_planted_and_random_texts(spark, monkeypatch, limit):
    monkeypatch.setattr(dc, "BROADCAST_ROWS", limit)
    rng = random.Random(8)
    vocabulary = ["the", "of", "a", "b", "c", "É", "été", "x1", "Z"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([1, 2, 3, 5, 9, 10, 11, 14, 30, 30])] + [(50, None), (51, ""), (52, " .,"), (53, "alpha beta"), (None, "q " * 12)]
    items += [(54, items[8][1])]
    docs = [(i, text(rng.randint(0, 40))) for i in range(60)]
    docs += [(100, "lead " + items[8][1] + " tail " + items[8][1]), (101, None), (102, ""), (103, "q " * 30), (104, items[7][1].upper().replace(" ", ", ")), (105, "ALPHA... Beta")]
    got = rows_of(dc.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert got == brute(docs, items)


def test_lower_cases_ascii_letters_only(spark):
    texts = ["ABC É", "İI ſK", "Ⅳ Ⓐ x", "ΣΑΣ A", "plain Ünder", "ǅ Dž", "𝐀 A 𐐀"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r.w for r in df.select(dc.words(F.col("text")).alias("w")).collect()] == [words_of(t) for t in texts]


def test_odd_tables(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, item, "x"), (1, item, "x"), (None, item, "y"), (None, None, "y"), (2, "one two", "z")], "doc_id long, text string, h string")
    bench = spark.createDataFrame([(7, item, 1), (7, item, 1)], "item_id long, text string, shingle int")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in dc.report(docs, bench).collect()), key=str)
    assert got == sorted([(1, 11, 11, 1), (1, 11, 11, 1), (None, 11, 11, 1), (None, 0, 0, 0), (2, 2, 0, 0)], key=str)
    assert dc.report(docs.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in dc.report(docs, bench.limit(0)).collect())


def test_report_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = {r[0]: r[1:] for r in con.execute(dc.SQL).fetchall()}
    got = rows_of(dc.report(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")))
    assert got == want and any(v[4] for v in got.values())


def test_places_are_joined_by_number(spark):
    """A word costs a look-up of a hash: no copies of the word array, and no shingle is made before its hash is found."""
    docs = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    hashes = spark.createDataFrame([("a b c",), ("",)], "shingle string").select(dc.shingle_hash(F.col("shingle")).alias("hash"))
    found = dc.positions(docs, [3]).join(F.broadcast(hashes), "hash", "left_semi")
    assert [(r.pos, r.shingle) for r in found.orderBy("pos").collect()] == [(-1, ""), (0, "a b c")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "arrays_zip" not in plan and "slice(" not in plan
    assert re.search(r"BroadcastHashJoin \[hash#\d+L\], \[hash#\d+L\], LeftSemi", plan)


@pytest.mark.parametrize("limit", [0, 500_000])
def test_shingles_decide_where_hashes_clash(spark, monkeypatch, limit):
    """With four hashes for all shingles, nearly every place passes the first join; the later ones alone decide."""
    monkeypatch.setattr(dc, "BROADCAST_ROWS", limit)
    real = F.xxhash64
    monkeypatch.setattr(dc.F, "xxhash64", lambda *c: real(*c) if isinstance(c[0], str) else F.pmod(real(*c), F.lit(4)))
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choices("abcdefgh", k=n))
    items = [(i, text(n)) for i, n in enumerate([1, 2, 4, 12, 20])]
    docs = [(i, text(rng.randint(0, 30))) for i in range(30)] + [(50, f"x {items[3][1]} y {items[4][1]}"), (51, None), (52, items[2][1])]
    got = rows_of(dc.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert got == brute(docs, items) and got[50][2] >= 2
